"""runlens: experiment-log analytics and corpus preparation as Spark DataFrame operators."""
