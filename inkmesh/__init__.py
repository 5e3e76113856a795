"""inkmesh: bibliographic and document analytics as lazy PySpark DataFrame pipelines."""
