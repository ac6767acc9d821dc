"""millrace: stream and table operators written as plain PySpark.

Every operator is a function from DataFrames to a DataFrame.  The packages are

* ``functions``  - column expressions (text, time, numbers, arrays, protection)
* ``operators``  - ordered sequences, joins, aggregates, routing, top-k
* ``sources``    - readers and writers with explicit schemas
* ``streaming``  - Structured Streaming forms of the operators
* ``plans``      - the registered queries, each next to its check SQL
"""
