"""Change history and diffs of a repository, read once by the git command on the driver."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import stored

CHUNK = 50_000
CHANGES = "path string, commit string, ts long, author string, added long, deleted long, is_root boolean"


class GitError(RuntimeError):
    pass


def available(root: str) -> bool:
    return os.path.exists(os.path.join(root, ".git"))


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def _history(root: str, since: int | None) -> Iterator[tuple]:
    """Rows of CHANGES, as the command writes them."""
    args = ["log", "--diff-merges=first-parent", "--root", "-M", "-z", "--numstat", "--format=%x01%H%x02%ct%x02%an%x02%ae%x02%P%x03"]
    with subprocess.Popen(["git", "-C", root, *args, *([f"--since={since}"] if since is not None else [])], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace") as log:
        held = ""
        while part := log.stdout.read(1 << 20):
            *blocks, held = (held + part).split("\x01")
            for block in blocks:
                yield from _commit(block)
        yield from _commit(held)
        said = log.stderr.read()
    if log.returncode:
        raise GitError(said.strip() or "git log failed")


def _commit(block: str) -> Iterator[tuple]:
    head, mark, body = block.partition("\x03")
    if not mark:
        return
    commit, ts, name, email, parents = head.split("\x02")
    author, root_commit = name.strip() or email.strip() or "unknown", not parents.strip()
    fields = iter(body.strip("\n\0").split("\0"))
    for field in fields:
        parts = field.strip("\n").split("\t")
        if len(parts) == 3:
            path = parts[2]
            if not path:  # a rename: old and new name follow
                next(fields)
                path = next(fields)
            added, deleted = (int(x) if x.isdigit() else 0 for x in parts[:2])
            yield path, commit, int(ts), author, added, 0 if root_commit else deleted, root_commit


def changes(spark: SparkSession, root: str, days: int | None = 90, as_of: int | None = None) -> DataFrame:
    """One row for each file of each commit against its first parent, within ``days`` before ``as_of`` (epoch seconds; the last commit's time if not given). Empty without a repository.

    A renamed file counts under its new name, a removed one under its old name. The command is
    asked for the window alone; what it writes is stored ``CHUNK`` rows at a time.
    """
    empty = spark.createDataFrame([], CHANGES)
    if not available(root):
        return empty
    since = None
    if days is not None:
        last = as_of if as_of is not None else int(_git(root, "log", "-1", "--format=%ct") or 0)
        since = last - days * 86_400
    rows, out = _history(root, since), empty
    while chunk := list(islice(rows, CHUNK)):
        out = out.union(stored(spark.createDataFrame(chunk, CHANGES), "changes"))
    return out if since is None else out.where(F.col("ts") >= since)


def modified(spark: SparkSession, root: str, base: str = "") -> DataFrame:
    """``(file)`` changed since ``base`` (if given) or in the working tree: changed, added and untracked, but not removed there. Raises GitError instead of reporting nothing."""
    if not available(root):
        raise GitError(f"{root} is not a git repository")
    files = set()
    if base:
        for line in _git(root, "-c", "core.quotepath=off", "diff", "--name-status", "-M", f"{base}..HEAD").splitlines():
            files.add(line.split("\t")[-1])
    for line in _git(root, "-c", "core.quotepath=off", "status", "--porcelain", "-uall").splitlines():
        if line[:2] not in (" D", "D "):
            files.add(line[3:].split(" -> ")[-1].strip('"'))
    return spark.createDataFrame([(f,) for f in sorted(files)], "file string")
