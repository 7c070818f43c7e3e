"""Operations of a training-data pipeline, each written as a Spark job over a
``documents``-shaped DataFrame.  Nothing outside this subpackage imports it."""
