"""ctxengine: a PySpark-native engine for language-model context and training text."""
