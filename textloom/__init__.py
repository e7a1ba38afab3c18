"""textloom: a Spark-native engine that turns crawled web pages into clean, chunked text."""
