"""PySpark-native analytics for replicate assay data.

Sub-packages
------------
functions   Column -> Column expressions
sources     readers, writers, checkpoints and name normalisation
operators   DataFrame -> DataFrame building blocks (grouping, joins, ranks, statistics, models)
plans       composite analyses built from the operators (QC, harmonisation, absorption, risk, modelling)
catalog     the registered queries over the test tables, each with its SQL oracle where SQL can say it
"""

__version__ = "0.1.0"
