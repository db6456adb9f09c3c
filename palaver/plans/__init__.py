"""Named queries: operators bound to tables, with the SQL that states the same result."""
