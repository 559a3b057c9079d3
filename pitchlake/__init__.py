"""Match-event analytics and relational building blocks on PySpark."""
