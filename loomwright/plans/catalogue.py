"""Every query of the library's core, by the inventory's ids, with the DuckDB SQL that checks it."""

from loomwright.plans import assessment_queries, chunk_queries, document_queries, governance_queries, metadata_queries, more_queries, profile_queries, register_queries, relational_queries, text_queries


def counted(sql: str) -> str:
    """DuckDB's count_if is a HUGEINT; Spark's is a BIGINT."""
    out, at = "", 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 1, start + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:start] + "CAST(count_if(" + counted(sql[start + 9 : end - 1]) + ") AS BIGINT)"
        at = end
    return out + sql[at:]


MODULES = (profile_queries, text_queries, relational_queries, governance_queries, metadata_queries, more_queries, assessment_queries, chunk_queries, document_queries, register_queries)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE: dict = {name: counted(sql) for module in MODULES for name, sql in module.ORACLE.items()}
