"""DNS threat analytics on Spark: names, detectors, fusion, history and dashboards as DataFrame transforms."""
