"""Python data source ``git_log``: commits with changed files and snapshots, in slices of a repository's history.

Options: ``repos`` (name=path, comma-joined), ``since`` (ISO date), ``stop_at``
(name=sha, comma-joined; that commit and its ancestors are left out, and a sha
that is gone walks to the floor), ``content_cap``, ``diff_cap``, ``max_files`` (a
commit's files of which a snapshot is taken; all are listed).  Root commits are
left out.  Diffs are against the first parent.

The driver lists each history once, by hash.  A task reads its slice with four git
processes, however many commits and files it has.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.sources.tree import Blobs, git, git_lines, real_root

SCHEMA = (
    "repo string, sha string, short_sha string, parent_sha string, author string, committed_at timestamp, message string, "
    "files array<struct<path:string,status:string,old_path:string,additions:int,deletions:int>>, "
    "snapshots array<struct<path:string,old_path:string,status:string,content:string,content_size:int,content_truncated:boolean,diff_unified:string,diff_size:int,diff_truncated:boolean>>"
)
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "modified"}


def pairs(option: str) -> dict[str, str]:
    return dict(x.split("=", 1) for x in option.split(",") if "=" in x)


def cap(raw: bytes, most: int) -> tuple[str, bool]:
    """At most ``most`` bytes, whole code points and, where possible, whole lines; a note of the size if cut."""
    if len(raw) <= most:
        return raw.decode("utf-8", "replace"), False
    head = raw[:most].decode("utf-8", "ignore")
    at = head.rfind("\n")
    return (head[:at] if at > 0 else head) + f"\n... [truncated, original {len(raw)} bytes]", True


#: Commits that one task reads.
SLICE = 500


@dataclass
class Repo(InputPartition):
    repo: str
    path: str
    shas: list


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.repos = pairs(options["repos"])
        self.stops = pairs(options.get("stop_at", ""))
        self.since = options.get("since", "")
        self.content_cap, self.diff_cap = int(options.get("content_cap", "16384")), int(options.get("diff_cap", "8192"))
        self.max_files = int(options.get("max_files", "50"))

    def partitions(self):
        """``SLICE`` commits each, of a history that is pinned to today's head."""
        out = []
        for name, where in sorted(self.repos.items()):
            path, stop = real_root(where), self.stops.get(name, "")
            head = git(path, "rev-parse", "HEAD").decode().strip()
            walk = ["--date-order", "--min-parents=1", *([f"--since={self.since}"] if self.since else []), head]
            if stop:
                try:
                    git(path, "cat-file", "-e", stop + "^{commit}")
                    walk.append("^" + stop)
                except Exception:  # the sha is gone after a forced push: walk to the floor
                    pass
            shas = git(path, "rev-list", *walk).decode().split()
            out += [Repo(name, path, shas[at : at + SLICE]) for at in range(0, len(shas), SLICE)]
        return out or [Repo("", "", [])]

    def read(self, part):
        if not part.shas:
            return
        log = git(part.path, "log", "--no-walk=unsorted", "--stdin", "--format=%H%x1f%P%x1f%an <%ae>%x1f%ct%x1f%B%x1e", given="\n".join(part.shas))
        heads = [f for f in (e.strip("\n").split("\x1f") for e in log.decode("utf-8", "replace").split("\x1e")) if len(f) >= 5]
        pairs_ = "".join(f"{f[0]} {f[1].split()[0]}\n" for f in heads)  # each commit and its first parent
        changed = listed(git(part.path, "diff-tree", "--stdin", "-r", "-M", "--raw", "--numstat", "-z", "--abbrev=40", given=pairs_))
        shown = self.diffs(part.path, pairs_)
        with Blobs(part.path) as blobs:
            for sha, parents, author, when, message in (f[:5] for f in heads):
                rows = changed.get(sha, [])
                files = [(name, STATUS.get(kind, "modified"), old, add, rem) for kind, old, name, _, add, rem in rows]
                yield part.repo, sha, sha[:7], parents.split()[0], author, datetime.fromtimestamp(int(when), timezone.utc), message, files, self.snapshots(rows, shown.get(sha, []), blobs)

    def snapshots(self, rows: list, shown: list, blobs: Blobs) -> list:
        out, taken = [], 0
        for (kind, old, name, blob, _, _), (head, size) in zip(rows, shown, strict=False):
            if kind == "D" or taken >= self.max_files:
                continue
            raw = blobs.read(blob)
            if raw is not None and b"\0" not in raw[:4096]:
                content, cut = cap(raw, self.content_cap)
                diff, _ = cap(head, self.diff_cap)
                if size > self.diff_cap:
                    diff = diff.rsplit("\n... [truncated", 1)[0] + f"\n... [truncated, original {size} bytes]"
                out.append((name, old, STATUS.get(kind, "modified"), content, len(raw), cut, diff, size, size > self.diff_cap))
                taken += 1
        return out

    def diffs(self, root: str, pairs_: str) -> dict[str, list]:
        """Per commit and file, in order, the diff's first bytes, somewhat more than the cap, and its size: whole diffs are never held."""
        out: dict[str, list] = {}
        files: list = []
        for line in git_lines(root, "diff-tree", "--stdin", "-r", "-M", "-p", "--no-color", given=pairs_):
            if line[:1] not in b" +-@\\" and len(line) == 41 and all(c in b"0123456789abcdef" for c in line[:40]):
                files = out.setdefault(line[:40].decode(), [])
            elif line.startswith(b"diff --git "):
                files.append([line, len(line)])
            elif files:
                if len(files[-1][0]) <= self.diff_cap:
                    files[-1][0] += line
                files[-1][1] += len(line)
        return out


def listed(raw: bytes) -> dict[str, list]:
    """Per commit (kind, old path, path, blob, additions, deletions) of each file, from NUL-separated raw entries and numbers."""
    out: dict[str, list] = {}
    fields, i, rows, counts = raw.decode("utf-8", "replace").split("\0"), 0, [], {}

    def close():
        for k, r in enumerate(rows):
            rows[k] = (*r, *counts.get(r[2], (0, 0)))

    while i < len(fields) and fields[i]:
        x = fields[i]
        if x.startswith(":"):
            blob, kind = x.split(" ")[3], x.split(" ")[4][0]
            moved = kind in "RC"
            rows.append((kind, fields[i + 1] if moved else None, fields[i + 2] if moved else fields[i + 1], blob))
            i += 3 if moved else 2
        elif "\t" in x:
            add, rem, name = x.split("\t", 2)
            if not name:  # a rename: old and new path follow
                name = fields[i + 2]
                i += 2
            counts[name] = (int(add) if add.isdigit() else 0, int(rem) if rem.isdigit() else 0)
            i += 1
        else:
            close()
            rows, counts = out.setdefault(x.strip(), []), {}
            i += 1
    close()
    return out


class GitLogSource(DataSource):
    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GitLogReader(self.options)


def read_log(spark, repos: dict[str, str], **options):
    spark.dataSource.register(GitLogSource)
    reader = spark.read.format("git_log").option("repos", ",".join(f"{k}={v}" for k, v in repos.items()))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
