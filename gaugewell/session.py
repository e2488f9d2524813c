"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Folders of single-machine contexts that name none, and contexts whose workers have the package.
_own_roots: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_shipped: weakref.WeakSet = weakref.WeakSet()
#: Paths made inside each open scope.
_scopes: list[list[str]] = []

# Runtime settings the operators rely on; everything else is the cluster's.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # short values compress well: 8 MB of them are some 300 MB in the hash table of a task that counts them
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # the JVM never compiles methods over 8000 bytes; past that, fused code is
    # slower than operator-level code, which wide tables then get
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # a JSON object may repeat a key and is still JSON
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", app: str = "gaugewell") -> SparkSession:
    """A single-machine session, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints.

    Where ``spark.checkpoint.dir`` is unset, a single-machine session gets a temporary folder, the
    same as long as its context lives. A cluster must name one: its machines would each
    write to a folder of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if context not in _own_roots:
        _own_roots[context] = tempfile.mkdtemp(prefix="gaugewell-")
    return _own_roots[context]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. What is written there is needed as long as results that read it."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _scopes:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove in the end what was written to scratch paths made inside; results must be stored elsewhere by then."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes[:] = [s for s in _scopes if s is not made]
        for path in made:
            remove_path(spark, path)


def ship(spark: SparkSession) -> SparkSession:
    """Give the package's modules to the Python workers of a cluster that does not have it installed, once for each context."""
    context, root = spark.sparkContext, Path(__file__).parent
    if context not in _shipped and root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="gaugewell-code-")) / "gaugewell_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(root.rglob("*.py")):
                out.write(module, module.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context)
    return spark


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return hadoop_path.getFileSystem(conf).exists(hadoop_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove what a run has written to a scratch path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text; False if it is there already, whoever else tries at the same time."""
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if files.getUri().getScheme() == "file":
            # a link, as a rename could replace what came in between
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(draft, target, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except FileExistsError:
        return False
    except Py4JJavaError:
        if files.exists(target):
            return False
        raise
    finally:
        if files.exists(draft):
            files.delete(draft, False)
