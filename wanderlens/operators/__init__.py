"""Analytics operators: typed DataFrames in, typed DataFrames out.

No operator hints a broadcast. Dimension tables (stations, spots, POIs) come from Parquet or the
cache, so Spark knows their size and broadcasts them below ``autoBroadcastJoinThreshold``; above
it the join is a sort-merge join whose skewed partitions AQE splits. Fact tables are combined per
key before they meet a join or a window, so that a hot user or spot shrinks on the map side.
"""
