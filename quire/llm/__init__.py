"""Operations of a training-data pipeline; nothing else in the library imports this."""

from quire.llm.queries import QUERIES, SQL  # noqa: F401
