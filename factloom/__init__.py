"""factloom: a Spark-native engine for analysing collections of open reporting."""
