"""Analytics over binary object-storage archives on Spark."""
