"""deploom: dependency-graph and binary-size analytics as Spark DataFrame plans."""
