"""Queries with DuckDB SQL for each; importing the package registers all of them."""

from . import catalog, stored  # noqa: F401
