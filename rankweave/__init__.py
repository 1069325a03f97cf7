"""rankweave: a PySpark-native engine for ranking features, click-through assembly and offline ranking evaluation."""
