"""Registration of queries beside their SQL."""


def registrar(queries: dict, oracles: dict):
    """A decorator that registers a function of (spark, sf_dir) under its name, with its DuckDB SQL if there is any."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query
