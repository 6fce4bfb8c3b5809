"""weftgraph: item-graph analytics and corpus preparation on PySpark DataFrames."""
