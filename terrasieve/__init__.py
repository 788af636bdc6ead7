"""terrasieve: per-pixel time series, parcel and district analytics on Spark."""
