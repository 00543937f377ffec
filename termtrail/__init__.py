"""Student-journey analytics as Spark DataFrame operators.

``functions``  Column builders: term codes, recodes, rates, sequences, pathways.
``operators``  DataFrame -> DataFrame building blocks: rollups, counts, disclosure, checks.
``sources``    Schemas, readers, sinks and the adapter over the driver's test tables.
``plans``      The layered student table and the report jobs built from the operators.
"""
