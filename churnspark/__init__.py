"""churnspark: churn analytics as Spark DataFrame operators.

Sub-packages
------------
sources    readers, writers and the test views built from the base tables
functions  column expressions (target binarisation, string coercion, labels)
operators  DataFrame -> DataFrame operators: profile, signal, features, split,
           preprocessing, training, metrics, scoring, explanation
plans      end-to-end plans that chain operators (train, score, report)
streaming  Structured Streaming scoring and churn-rate monitoring
"""

__version__ = "0.1.0"
