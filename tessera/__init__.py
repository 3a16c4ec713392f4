"""tessera — supervised learning on tables, expressed as Spark DataFrame jobs.

Every operator takes and returns Spark DataFrames (or fitted ``pyspark.ml``
models).  Only bounded metadata (one row per column, per class, per
vocabulary term) is ever brought to the driver.

Sub-packages
------------
sources    file / table scans and sinks (CSV, experiment table, run log, artefacts)
functions  reusable Column expressions (string-to-number rules, Unicode text helpers)
operators  profiling, cleaning, features, TF-IDF, models, metrics, rules, memory, report
plans      the chained ``run()`` and the registered query catalogue
streaming  scoring a stream with a fitted preprocessing + model pipeline
"""

__version__ = "0.1.0"
