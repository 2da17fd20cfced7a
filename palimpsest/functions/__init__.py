"""Column functions and the small row helpers that run inside tasks."""
