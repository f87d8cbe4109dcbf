"""growthlens: product-analytics operators (funnels, cohort retention, GMV growth,
concentration, cancellations, first-event outcomes and the statistics that judge
them) expressed as Spark DataFrame plans.

Every operator is a plain function ``DataFrame(s) -> DataFrame``; no operator
creates a session, collects a table to the driver, or runs a row-at-a-time UDF.
"""

__version__ = "0.1.0"
