"""threadloom: code and text context building over whole tables, on Spark."""
