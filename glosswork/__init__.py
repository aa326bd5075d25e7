"""A Spark-native engine that ranks and selects the spans most worth reading in long documents."""
