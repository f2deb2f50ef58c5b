"""kinsift: record linkage and training-data preparation on Spark DataFrames.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column builders),
``operators`` (relational building blocks), ``plans`` (compound plans and the
registered queries), ``streaming`` (incremental matching) and, standing alone,
``llm`` (preparation of training data).
"""
