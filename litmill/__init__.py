"""litmill: literature and text corpus analytics on PySpark."""
