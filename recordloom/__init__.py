"""Record cleaning and group comparison for Spark.

``plans.cleaning.clean`` turns raw entity-attribute-value answers into one
clean row per visit; ``plans.quality``, ``plans.flow`` and
``operators.compare`` report on the result.
"""
