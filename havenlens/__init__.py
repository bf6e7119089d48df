"""Customer-360, churn score and next best action as PySpark DataFrame operators."""
