"""What __spark_entry__.py adds of this subpackage."""

from medialens.llm.oracles import oracle_sql
from medialens.llm.queries import queries

__all__ = ["oracle_sql", "queries"]
