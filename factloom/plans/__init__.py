"""Named queries over the driver's tables, with the SQL that says the same."""
