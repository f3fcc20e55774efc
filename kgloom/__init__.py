"""kgloom: typed-graph, link-prediction and corpus analytics expressed as Spark DataFrame jobs."""
