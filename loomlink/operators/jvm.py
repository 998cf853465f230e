"""Java classes of this folder, compiled by the compiler that Spark brings for its own code and given to the executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_LOADERS: dict[str, object] = {}


def _loader(spark, name: str):
    """A class loader for ``name``, whose jar the session's executors have; made once for each application."""
    jvm, key = spark.sparkContext._jvm, f"{spark.sparkContext.applicationId} {name}"
    if key not in _LOADERS:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        parent = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        compiler.setParentClassLoader(parent)
        compiler.cook(Path(__file__).with_name(f"{name}.java").read_text())
        handle, jar = tempfile.mkstemp(".jar", f"loomlink-{name}-")
        with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for c, code in dict(compiler.getBytecodes()).items():
                z.writestr(c.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(jar)
        urls = spark.sparkContext._gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(jar).toURI().toURL()
        _LOADERS[key] = jvm.java.net.URLClassLoader(urls, parent)
    return _LOADERS[key]


def map_partitions(df: DataFrame, schema: StructType, name: str, *args) -> DataFrame:
    """``df`` through the ``MapPartitionsFunction`` that the class ``name`` makes from ``args``."""
    spark = df.sparkSession
    context = spark.sparkContext
    given = context._gateway.new_array(context._jvm.java.lang.Object, len(args))
    for n, a in enumerate(args):
        given[n] = a
    function = _loader(spark, name).loadClass(f"loomlink.{name}").getConstructors()[0].newInstance(given)
    row = context._jvm.org.apache.spark.sql.Encoders.row(spark._jsparkSession.parseDataType(schema.json()))
    return DataFrame(df._jdf.mapPartitions(function, row), spark)
