"""Reading raw and clean tables, and writing tables and reports."""
