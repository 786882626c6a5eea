"""Spark-native engine over captured documents: outlines, budgets, verdicts, attempts and manifests as DataFrame plans."""
