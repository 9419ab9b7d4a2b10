"""Operations of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``queries`` holds the thin registered queries and their SQL.
"""
