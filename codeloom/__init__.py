"""Analytics over corpora of program code and text, written as Spark jobs."""
