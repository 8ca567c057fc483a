"""Registered queries over the warehouse tables, each with the SQL that must give the same rows."""
