"""Property graphs on Spark DataFrames: vertices(id, attr) and edges(src, dst, attr)."""

__all__ = ["PropertyGraph"]


def __getattr__(name: str):
    if name == "PropertyGraph":
        from gridgraph.graph import PropertyGraph

        return PropertyGraph
    raise AttributeError(name)
