"""Named query plans over the driver's test data (:mod:`souk.plans.registry`)
and their independent DuckDB oracle statements (:mod:`souk.plans.oracle`)."""
