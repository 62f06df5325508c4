"""Python data source ``tree``: files below a root, from the working tree or a git ref.

Options: ``root``; ``exts`` (comma-joined, with dots; empty for all); ``skip``
(folder names to prune); ``ref`` (read a git ref instead of files);
``tracked`` (only files that git tracks); ``max_bytes``; ``slices`` (read
partitions); ``content`` (``false``: rows without it, and no file is opened whose
hash git knows).  Rows: path, sha, length, content.  The walk lists paths on the
driver; contents are read in the tasks.

Where ``spark.sql.python.filterPushdown.enabled`` is set when :func:`read_tree` is called, filters on ``path``
(equal, in, prefix, suffix) and on ``length`` keep files from being opened; a
prefix keeps folders from being walked.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SKIP = (".git", "node_modules", "target", "dist", "build", ".idea", ".vscode", "v1", ".worktrees", "short-term")
SCHEMA = "path string, sha string, length long, content binary"
BARE = "path string, sha string, length long"
HEAD, MAX_FILE = 4096, 2 << 20


def real_root(path: str) -> str:
    return os.path.realpath(os.path.abspath(os.path.expanduser(path)))


def checked_ref(ref: str) -> str:
    if ref.startswith("-") or not ref:
        raise ValueError(f"bad git ref {ref!r}")
    return ref


def git(root: str, *args: str, given: str | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, input=None if given is None else given.encode()).stdout


def git_lines(root: str, *args: str, given: str) -> Iterator[bytes]:
    """The output's lines one by one."""
    with tempfile.TemporaryFile() as asked:
        asked.write(given.encode())
        asked.seek(0)
        with subprocess.Popen(["git", "-C", root, *args], stdin=asked, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as p:
            yield from p.stdout
    if p.returncode:
        raise subprocess.CalledProcessError(p.returncode, args)


class Blobs:
    """Contents of blobs by hash, all through one git process."""

    def __init__(self, root: str):
        self.root, self.process = root, None

    def __enter__(self):
        self.process = subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        return self

    def __exit__(self, *_):
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def read(self, sha: str) -> bytes | None:
        """The blob's content; None where ``sha`` names no blob, as for a submodule."""
        self.process.stdin.write(sha.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) < 3:
            return None
        raw = self.process.stdout.read(int(head[2]))
        self.process.stdout.read(1)
        return raw if head[1] == b"blob" else None


def tracked_shas(root: str) -> dict[str, str]:
    """Path to blob hash of the index; empty where there is no repository."""
    try:
        out = git(root, "ls-files", "-s", "-z").decode("utf-8", "surrogateescape")
    except (subprocess.CalledProcessError, FileNotFoundError):
        return {}
    return {(p := line.partition("\t"))[2]: p[0].split()[1] for line in out.split("\0") if line}


def ref_shas(root: str, ref: str) -> dict[str, tuple[str, int]]:
    """Path to hash and length of the blobs of a ref."""
    out = git(root, "ls-tree", "-r", "-l", "-z", checked_ref(ref)).decode("utf-8", "surrogateescape")
    rows = ((line.partition("\t")[2], line.partition("\t")[0].split()) for line in out.split("\0") if line)
    return {name: (x[2], int(x[3])) for name, x in rows if x[1] == "blob"}


def walk(root: str, skip: tuple[str, ...], prefix: str = "") -> list[str]:
    """Paths below ``root`` that start with ``prefix``; only folders that can hold one are read."""
    out = []
    for folder, dirs, names in os.walk(root):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if at == "." else at + "/"
        dirs[:] = sorted(d for d in dirs if d not in skip and (prefix.startswith(f"{at}{d}/") or f"{at}{d}/".startswith(prefix)))
        out += [at + n for n in names if (at + n).startswith(prefix)]
    return sorted(out)


@dataclass
class Slice(InputPartition):
    files: list


#: Filters that a file's path decides, and those that its length decides.
ON_PATH = {
    ds.EqualTo: lambda f, x: x == f.value,
    ds.In: lambda f, x: x in f.value,
    ds.StringStartsWith: lambda f, x: x.startswith(f.value),
    ds.StringEndsWith: lambda f, x: x.endswith(f.value),
}
ON_LENGTH = {
    ds.EqualTo: lambda f, x: x == f.value,
    ds.LessThan: lambda f, x: x < f.value,
    ds.LessThanOrEqual: lambda f, x: x <= f.value,
    ds.GreaterThan: lambda f, x: x > f.value,
    ds.GreaterThanOrEqual: lambda f, x: x >= f.value,
}


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = real_root(options["root"])
        self.ref = options.get("ref", "")
        self.exts = tuple(x.strip().lower() for x in options.get("exts", "").split(",") if x.strip())
        self.skip = tuple(x for x in options.get("skip", ",".join(SKIP)).split(",") if x)
        self.tracked = options.get("tracked", "false").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.most = int(options.get("max_bytes", "0"))
        self.slices = int(options.get("slices", "8"))
        self.on_path: list = []
        self.on_length: list = []

    def wanted(self, name: str) -> bool:
        return (not self.exts or os.path.splitext(name)[1].lower() in self.exts) and all(ON_PATH[type(f)](f, name) for f in self.on_path)

    def fits(self, length: int) -> bool:
        return not (self.most and length > self.most) and all(ON_LENGTH[type(f)](f, length) for f in self.on_length)

    def partitions(self):
        prefix = max((f.value for f in self.on_path if isinstance(f, (ds.StringStartsWith, ds.EqualTo))), key=len, default="")
        if self.ref:
            found = ref_shas(self.root, self.ref)
            files = [(n, sha, size) for n, (sha, size) in sorted(found.items()) if not set(n.split("/")[:-1]) & set(self.skip)]
        else:
            shas = tracked_shas(self.root)
            files = [(n, shas.get(n), None) for n in (sorted(shas) if self.tracked else walk(self.root, self.skip, prefix))]
        files = [f for f in files if self.wanted(f[0]) and (f[2] is None or self.fits(f[2]))]
        return [Slice(files[i :: self.slices]) for i in range(min(self.slices, len(files)))] or [Slice([])]

    def row(self, name: str, sha: str, length: int, raw: bytes | None):
        return (name, sha, length, raw) if self.content else (name, sha, length)

    def read(self, partition):
        if self.ref and not self.content:
            for name, sha, size in partition.files:
                yield self.row(name, sha, size, None)
        elif self.ref:
            with Blobs(self.root) as blobs:
                for name, sha, size in partition.files:
                    yield self.row(name, sha, size, blobs.read(sha))
        else:
            for name, sha, _ in partition.files:
                full = os.path.join(self.root, name)
                try:
                    size = os.path.getsize(full)
                    if not self.fits(size):
                        continue
                    if sha and not self.content:
                        yield self.row(name, sha, size, None)
                        continue
                    with open(full, "rb") as f:
                        raw = f.read()
                except OSError:
                    continue
                if self.fits(len(raw)):
                    yield self.row(name, sha or hashlib.sha1(raw).hexdigest(), len(raw), raw)


class PushingReader(TreeReader):
    """A reader that takes filters; Spark refuses it where pushdown is off."""

    def pushFilters(self, filters):  # noqa: N802  the name that Spark calls
        """Takes the filters on path and length that it knows; all others stay with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and type(f) in ON_PATH:
                self.on_path.append(f)
            elif getattr(f, "attribute", None) == ("length",) and type(f) in ON_LENGTH:
                self.on_length.append(f)
            else:
                yield f


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return SCHEMA if self.options.get("content", "true").lower() == "true" else BARE

    def reader(self, schema):
        return PushingReader(self.options) if self.options.get("pushdown", "false") == "true" else TreeReader(self.options)


def read_tree(spark, root: str, **options):
    """The files below ``root`` as a DataFrame, registered source and all."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("root", root).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def knowledge_files(spark, root: str, projects=None, **options):
    """(source, source_sha, scope, doc_type, text) of the Markdown and YAML files of a tree."""
    from pyspark.sql import functions as F

    from quern.functions import dims

    t = read_tree(spark, root, exts=".md,.yaml", **options)
    return t.select(F.col("path").alias("source"), F.col("sha").alias("source_sha"), dims.path_scope("path", projects).alias("scope"), dims.path_doc_type("path").alias("doc_type"), F.decode("content", "UTF-8").alias("text"))


def memory_files(spark, root: str, prefix: str = "memory/"):
    """Memory notes: Markdown files but the index file, under ``prefix``."""
    from pyspark.sql import functions as F

    t = read_tree(spark, root, exts=".md").where(F.lower(F.regexp_extract("path", r"([^/]*)\z", 1)) != "memory.md")
    return t.select(F.concat(F.lit(prefix), "path").alias("source"), F.col("sha").alias("source_sha"), F.lit("universal").alias("scope"), F.lit("memory").alias("doc_type"), F.decode("content", "UTF-8").alias("text"))


def repo_files(spark, root: str, repo: str):
    """(repo, path, sha, language, text) of the tracked text files of a repository: at most 2 MB, no NUL in the first 4096 bytes."""
    from pyspark.sql import functions as F

    from quern.functions import dims

    t = read_tree(spark, root, tracked="true", max_bytes=MAX_FILE, skip="")
    binary = F.instr(F.hex(F.substring("content", 1, HEAD)), "00") > 0
    # A pair of hex digits may straddle two bytes: keep only even offsets.
    zero = F.regexp_like(F.hex(F.substring("content", 1, HEAD)), F.lit(r"\A(?:..)*?00"))
    return t.where(~(binary & zero)).select(F.lit(repo).alias("repo"), "path", "sha", dims.language("path").alias("language"), F.decode("content", "UTF-8").alias("text"))
