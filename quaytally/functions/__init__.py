"""Column functions: from columns to a column, no data access."""
