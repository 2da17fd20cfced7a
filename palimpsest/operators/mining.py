"""From commits to file changes with their contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.rows import element_rows

# Fixed values of the mining rules.
FIX_SUBJECT = "bug|fix|issue|error"
PYTHON_PATH = "%.py"
MAX_CHANGED_FILES = 5
RAW_URL = "https://raw.githubusercontent.com/%s/%s/%s"
CONTENTS_URL = "https://api.github.com/repos/%s/contents/%s?ref=%s"

CHANGE_KEYS = ["repository", "commit_before", "commit_after", "file_before", "file_after"]


def is_fix(subject: Column | str = "subject") -> Column:
    return (F.col(subject) if isinstance(subject, str) else subject).rlike(FIX_SUBJECT)


def python_files(difference: str = "difference") -> Column:
    """The changed files whose new path is a Python file."""
    return F.filter(difference, lambda d: d["new_path"].like(PYTHON_PATH))


def mine_commits(commits: DataFrame) -> DataFrame:
    """Commits with a fix subject that touch Python files, cut to those files."""
    touches = F.exists("difference", lambda d: d["new_path"].like(PYTHON_PATH))
    return commits.filter(is_fix() & touches).withColumn("difference", python_files())


def first_repository(commits: DataFrame, column: str = "repo_name") -> Column:
    """First of a list of names, or the name itself; null for an empty list."""
    if isinstance(commits.schema[column].dataType, T.ArrayType):
        return F.get(column, F.lit(0))
    return F.col(column)


def repository_violations(commits: DataFrame) -> DataFrame:
    """Commits whose repository list is empty, missing or has a repeated name."""
    names = F.col("repo_name")
    kind = (
        F.when(names.isNull(), "missing")
        .when(F.size(names) == 0, "empty")
        .when(F.size(names) != F.size(F.array_distinct(names)), "repeated")
    )
    return commits.withColumn("violation", kind).filter("violation IS NOT NULL")


def commit_drop_reason(max_files: int = MAX_CHANGED_FILES) -> Column:
    """Why a commit is not used, or null."""
    return (
        F.when(F.size("parent") == 0, "root commit")
        .when(F.size("difference") > max_files, "too many files")
    )


def file_drop_reason(d: Column) -> Column:
    """Why a changed file is not used, or null."""
    return F.when(d["old_mode"].isNull() | d["new_mode"].isNull(), "created or deleted")


def file_changes(commits: DataFrame, max_files: int = MAX_CHANGED_FILES) -> DataFrame:
    """One row per usable changed file with its place in the commit.

    The first parent of a merge is taken. All tests are built-in and sit before
    the explode, so a rejected commit costs nothing downstream.
    """
    usable = commits.filter(commit_drop_reason(max_files).isNull())
    keep = ["row_index"] if "row_index" in commits.columns else []
    rows = usable.select(
        F.col("repo_name").alias("repositories"),
        F.element_at("parent", 1).alias("commit_before"),
        F.col("commit").alias("commit_after"),
        *keep,
        "difference",
    )
    rows = element_rows(
        rows, "difference", "d", "repositories", "commit_before", "commit_after", *keep, pos="diff_index"
    )
    return rows.filter(file_drop_reason(F.col("d")).isNull()).select(
        "repositories",
        "commit_before",
        "commit_after",
        F.col("diff_index").cast("long").alias("diff_index"),
        F.col("d.old_path").alias("file_before"),
        F.col("d.new_path").alias("file_after"),
        *keep,
    )


def drop_reasons(commits: DataFrame, max_files: int = MAX_CHANGED_FILES) -> DataFrame:
    """Counts per reason, over commits and over files of kept commits."""
    reason = commit_drop_reason(max_files)
    per_commit = commits.select(reason.alias("reason"), F.lit("commit").alias("level"))
    per_file = (
        commits.filter(reason.isNull())
        .select(F.explode("difference").alias("d"))
        .select(file_drop_reason(F.col("d")).alias("reason"), F.lit("file").alias("level"))
    )
    return (
        per_commit.unionByName(per_file)
        .groupBy("level", F.coalesce("reason", F.lit("kept")).alias("reason"))
        .count()
    )


def raw_url(repository: Column | str, sha: Column | str, path: Column | str) -> Column:
    return F.format_string(RAW_URL, repository, sha, path)


def contents_url(repository: Column | str, path: Column | str, ref: Column | str) -> Column:
    return F.format_string(CONTENTS_URL, repository, path, ref)


def with_urls(changes: DataFrame) -> DataFrame:
    """Add the download addresses of both sides."""
    return changes.withColumns(
        {
            "url_before": raw_url("repository", "commit_before", "file_before"),
            "url_after": raw_url("repository", "commit_after", "file_after"),
        }
    )


_CHANGE_ID = ["commit_before", "commit_after", "diff_index", "file_before", "file_after"]


def pending_changes(changes: DataFrame, done: DataFrame) -> DataFrame:
    """Changes for which none of their repositories has a stored result."""
    found = (
        changes.select(F.explode("repositories").alias("repository"), *_CHANGE_ID)
        .join(done.select(*CHANGE_KEYS).distinct(), CHANGE_KEYS, "left_semi")
        .select(*_CHANGE_ID)
    )
    return changes.join(found, _CHANGE_ID, "left_anti")


def _requests(changes: DataFrame, repositories: Column) -> DataFrame:
    """Two rows per change and repository: the file before and after."""
    side = F.explode(
        F.array(
            F.struct(F.lit("before").alias("side"), F.col("commit_before").alias("sha"),
                     F.col("file_before").alias("path")),
            F.struct(F.lit("after").alias("side"), F.col("commit_after").alias("sha"),
                     F.col("file_after").alias("path")),
        )
    ).alias("s")
    return (
        changes.select(*_CHANGE_ID, F.posexplode(repositories).alias("choice", "repository"))
        .select("*", side)
        .select(*_CHANGE_ID, "choice", "repository", "s.side", "s.sha", "s.path")
    )


def _answers(requests: DataFrame, contents: DataFrame) -> DataFrame:
    """Changes per chosen repository for which both sides arrived.

    The contents are the big table: they are filtered first and shuffled once
    for both sides.
    """
    ok = contents.filter("status = 200").select("repository", "sha", "path", "text")
    found = requests.join(ok, ["repository", "sha", "path"])
    return (
        found.groupBy(*_CHANGE_ID, "choice", "repository")
        .agg(
            F.max(F.when(F.col("side") == "before", F.col("text"))).alias("code_before"),
            F.max(F.when(F.col("side") == "after", F.col("text"))).alias("code_after"),
        )
        .filter("code_before IS NOT NULL AND code_after IS NOT NULL")
    )


def attach_contents(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """File changes with both texts, read from the first repository."""
    requests = _requests(changes, F.slice("repositories", 1, 1))
    return with_urls(_answers(requests, contents).drop("choice"))


def attach_contents_with_forks(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """As :func:`attach_contents`, trying the next repository of a change when
    one lacks a side; the earliest that has both is taken.

    The choice needs only keys, so no text of a repository that is not chosen
    is shuffled: the contents' keys decide, then the texts of the two chosen
    files of each change are fetched.
    """
    requests = _requests(changes, F.col("repositories"))
    keys = contents.filter("status = 200 AND text IS NOT NULL").select("repository", "sha", "path")
    there = requests.join(keys, ["repository", "sha", "path"], "left_semi")
    both = there.groupBy(*_CHANGE_ID, "choice").agg(
        F.first("repository").alias("repository"), F.count_distinct("side").alias("sides")
    )
    chosen = (
        both.filter("sides = 2")
        .groupBy(*_CHANGE_ID)
        .agg(F.min_by("repository", "choice").alias("repository"))
        .select(*_CHANGE_ID, F.array("repository").alias("repositories"))
    )
    return attach_contents(chosen, contents)
