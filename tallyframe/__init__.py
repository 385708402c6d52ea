"""Statement analytics on Spark: ledgers from bank statements, and what is done with them."""
