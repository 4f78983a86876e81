"""filmloom: Spark-native processing of chunked multimedia relations."""
