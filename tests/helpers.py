import math


def rows(df):
    return [r.asDict() for r in df.collect()]


def keyed(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def close(a, b, rel=1e-9, abs_=1e-12):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=rel, abs_tol=abs_)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
