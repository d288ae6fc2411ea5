"""End-to-end plans: the monthly analysis run, report datasets, reference SQL."""
