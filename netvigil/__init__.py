"""Security-telemetry analytics on Spark: packets, firewall logs and alerts as DataFrames."""
