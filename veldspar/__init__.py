"""Analytics operators for Spark: functions from DataFrame to DataFrame, planned by Catalyst."""
