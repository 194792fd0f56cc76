"""corpusloom: a Spark-native engine for building and auditing large text corpora."""
