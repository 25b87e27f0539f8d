"""Every operator applied to the tables, by key."""

from citelens.catalog import files, models, relational, text  # noqa: F401
from citelens.catalog.registry import QUERIES, SQL  # noqa: F401
