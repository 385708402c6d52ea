"""Named queries over the star-schema tables, and the same in SQL."""
