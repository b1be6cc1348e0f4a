"""Document-table analytics on Spark: typed pages, rows and cells, and what is computed over them."""
