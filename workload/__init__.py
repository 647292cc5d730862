"""The registered queries over the provided tables, each with SQL that must give the same rows."""
