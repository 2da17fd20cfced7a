"""Mining queries over the commits view."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.text import strip_nul
from palimpsest.operators import mining as M
from palimpsest.plans.registry import query
from palimpsest.plans.views import COMMITS_SQL, commits, contents

_W = f"WITH {COMMITS_SQL}"
_FIX = "regexp_matches(subject, 'bug|fix|issue|error')"


@query("fix_subjects", f"{_W} SELECT subject, {_FIX} AS is_fix, count(*) AS n FROM commits GROUP BY ALL")
def fix_subjects(t):
    return commits(t).groupBy("subject", M.is_fix().alias("is_fix")).agg(F.count("*").alias("n"))


@query("mined_commits", f"""{_W}
SELECT commit, subject, count(*) AS n_files, string_agg(new_path, ',' ORDER BY i) AS paths FROM files
WHERE {_FIX} AND new_path LIKE '%.py' GROUP BY commit, subject""")
def mined_commits(t):
    return M.mine_commits(commits(t)).select(
        "commit", "subject", F.size("difference").cast("long").alias("n_files"),
        F.concat_ws(",", "difference.new_path").alias("paths"))


@query("repository_violations", f"""{_W}
SELECT commit, CASE WHEN len(repo_name) = 0 THEN 'empty' ELSE 'repeated' END AS violation FROM commits
WHERE len(repo_name) = 0 OR len(repo_name) <> len(list_distinct(repo_name))""")
def repository_violations(t):
    return M.repository_violations(commits(t)).select("commit", "violation")


@query("first_repository", f"{_W} SELECT commit, repo_name[1] AS repository FROM commits")
def first_repository(t):
    c = commits(t)
    return c.select("commit", M.first_repository(c).alias("repository"))


@query("file_changes", f"""{_W}
SELECT array_to_string(repo_name, ',') AS repositories, commit_before, commit_after, diff_index, file_before, file_after FROM changes""")
def file_changes(t):
    return M.file_changes(commits(t)).withColumn("repositories", F.concat_ws(",", "repositories"))


@query("drop_reasons", f"""{_W}
SELECT 'commit' AS level, CASE WHEN parents = 0 THEN 'root commit' WHEN n_files > 5 THEN 'too many files' ELSE 'kept' END AS reason,
  count(*) AS count FROM commits GROUP BY ALL
UNION ALL
SELECT 'file', CASE WHEN has_modes THEN 'kept' ELSE 'created or deleted' END, count(*) FROM files
WHERE parents > 0 AND n_files <= 5 GROUP BY ALL""")
def drop_reasons(t):
    return M.drop_reasons(commits(t))


@query("download_urls", f"""{_W}, x AS (SELECT *, repo_name[1] AS r FROM changes WHERE len(repo_name) > 0)
SELECT commit_after, diff_index, 'https://raw.githubusercontent.com/' || r || '/' || commit_before || '/' || file_before AS url_before,
  'https://raw.githubusercontent.com/' || r || '/' || commit_after || '/' || file_after AS url_after,
  'https://api.github.com/repos/' || r || '/contents/' || file_after || '?ref=' || commit_after AS api_after FROM x""")
def download_urls(t):
    first = M.file_changes(commits(t)).withColumn("repository", F.get("repositories", F.lit(0)))
    urls = M.with_urls(first.filter("repository IS NOT NULL"))
    return urls.select("commit_after", "diff_index", "url_before", "url_after", M.contents_url(
        "repository", "file_after", "commit_after").alias("api_after"))


_DONE = f"""{_W}, done AS (SELECT repo_name[len(repo_name)] AS repository, commit_before, commit_after, file_before, file_after
  FROM changes WHERE part % 4 = 0 AND len(repo_name) > 0)"""


@query("pending_changes", f"""{_DONE}
SELECT commit_after, diff_index, file_after FROM changes c WHERE NOT EXISTS (SELECT 1 FROM done d
  WHERE list_contains(c.repo_name, d.repository) AND d.commit_before = c.commit_before AND d.commit_after = c.commit_after
    AND d.file_before = c.file_before AND d.file_after = c.file_after)""")
def pending_changes(t):
    changes = M.file_changes(commits(t))
    part = F.regexp_extract("file_after", "m([0-9]+)", 1).cast("long")
    done = changes.filter((part % 4 == 0) & (F.size("repositories") > 0)).withColumn(
        "repository", F.element_at("repositories", -1))
    return M.pending_changes(changes, done).select("commit_after", "diff_index", "file_after")


_ATTACHED = "SELECT commit_after, diff_index, {0} AS repository, 'https://raw.githubusercontent.com/' || {0} || '/' || commit_after || '/' || file_after AS url_after, part FROM changes WHERE "


@query("attached_contents", f"""{_W}, a AS ({_ATTACHED.format('repo_name[1]')} len(repo_name) > 0 AND part % 11 <> 0 AND part % 4 <> 0)
SELECT commit_after, diff_index, repository, url_after, part % 20 = 0 AS broken_after FROM a""")
def attached_contents(t):
    out = M.attach_contents(M.file_changes(commits(t)), contents(t))
    return out.select("commit_after", "diff_index", "repository", "url_after",
                      F.col("code_after").contains("(path:").alias("broken_after"))


@query("attached_with_forks", f"""{_W}, a AS ({_ATTACHED.format("CASE WHEN part % 4 = 0 THEN repo_name[2] ELSE repo_name[1] END")}
  len(repo_name) > 0 AND part % 11 <> 0 AND (part % 4 <> 0 OR repo_name[2] LIKE 'fork%'))
SELECT commit_after, diff_index, repository, url_after FROM a""")
def attached_with_forks(t):
    out = M.attach_contents_with_forks(M.file_changes(commits(t)), contents(t))
    return out.select("commit_after", "diff_index", "repository", "url_after")


@query("nul_removed", "SELECT doc_id, len(text) AS n, text AS cleaned FROM documents")
def nul_removed(t):
    dirty = t.documents.select("doc_id", F.concat(
        F.substring("text", 1, 3), F.lit("\0"), F.substr("text", F.lit(4)), F.lit("\0")).alias("x"))
    return dirty.select("doc_id", strip_nul("x").alias("cleaned")).withColumn(
        "n", F.length("cleaned").cast("long"))
