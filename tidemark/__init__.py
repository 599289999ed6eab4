"""tidemark: leakage-safe, entity-level risk analytics written as Spark jobs.

Everything a record says up to its anchor date may shape a feature; nothing
after it may.  The package is a library of lazy DataFrame operators: sources,
audits, windowed features, guards, folds, models, metrics, scoring and streams.
"""

__version__ = "0.1.0"
