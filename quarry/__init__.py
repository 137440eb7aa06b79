"""quarry: Spark-native QA-dataset building, checking and evaluation.

Operators live in ``quarry.operators`` (DataFrame -> DataFrame), readers in
``quarry.sources``, writers in ``quarry.sinks``, streaming jobs in
``quarry.streaming`` and the registered queries with their DuckDB oracles in
``quarry.plans``.
"""

__version__ = "0.1.0"
