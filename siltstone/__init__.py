"""A Spark-native engine for searching and analysing a library of small texts and the references between them."""
