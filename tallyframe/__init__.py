"""tallyframe: ledger analytics as composable Spark DataFrame operators.

Every public operator is a function from DataFrame(s) (plus parameters) to a
DataFrame, so Catalyst plans the whole chain: scans prune columns and push
filters, aggregations run partial + final around one exchange, and nothing
is collected to the driver except bounded check frames.
"""

__version__ = "0.1.0"


def _ship_udfs_by_value() -> None:
    """Pickle this package's functions by value, so pandas UDF tasks need no installed copy."""
    try:
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001  (older cloudpickle: the package must be on the executors' path)
        pass


_ship_udfs_by_value()
