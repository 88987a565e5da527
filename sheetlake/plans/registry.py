"""How a plan module names its queries and their oracles."""


def registry():
    """Two dicts and the decorator that fills them: ``@register(name, oracle_sql)``."""
    queries: dict = {}
    oracles: dict = {}

    def register(name: str, oracle: str | None = None):
        def keep(run):
            queries[name] = run
            if oracle:
                oracles[name] = oracle
            return run
        return keep

    return queries, oracles, register
