"""graphloom: a Spark-native engine for code-dependency graphs and large text corpora."""
