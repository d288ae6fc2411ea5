"""salesflow: sales, stock and receivables analytics as Spark plans.

Layers: ``sources`` (where tables live), ``functions`` (column expressions),
``operators`` (conform, metrics, quantile, quality), ``plans`` (the monthly
run, report datasets, reference SQL), ``sinks`` (monthly snapshots).
"""

from salesflow.plans.pipeline import Analysis, AnalysisParams  # noqa: F401
