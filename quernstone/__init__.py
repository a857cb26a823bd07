"""quernstone: a PySpark-native engine for evidence-grounded analytics.

Operators are declared with the DataFrame/SQL API and left to Catalyst; Python
runs on executors only where no built-in function can express the semantics,
and then in Arrow batches.
"""

__version__ = "0.1.0"
