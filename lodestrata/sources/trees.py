"""Source trees, configuration, diffs, transcripts, event logs and manifests as DataFrames."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import subprocess
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scalar import matches_any
from lodestrata.runtime import partitions, ship

LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
GENERATED = r"(?i)(^|/)(migrations|node_modules|vendor|third_party|dist|build)/|(_pb2(_grpc)?\.pyi?|\.min\.js|\.generated\.[jt]sx?|\.d\.ts)$"
HEADER = r"(?i)(@generated|do not edit|auto-?generated|generated by)"
DEFAULT_EXCLUDE = ["**/.git/**", "**/__pycache__/**", "**/.venv/**", "**/node_modules/**", "**/target/**"]
EVENT = "kind string, ts long, repo string, branch string, origin string, detector string, fp long, config_hash string, reported map<string,long>, n_hits int, top_score double"


def _ignored(root: str) -> tuple[list[str], list[str]]:
    """Files below ``root`` that no ignore file or hidden rule leaves out, sorted; and what went wrong."""
    out, issues = [], []

    def walk(folder: str, rules: list[tuple[str, str]]) -> None:
        try:
            names = sorted(os.listdir(folder))
        except OSError as e:
            issues.append(f"{folder}: {e.strerror}")
            return
        for f in (".gitignore", ".ignore"):
            if f in names:
                with open(os.path.join(folder, f), errors="replace") as h:
                    rules = rules + [(folder, x.strip()) for x in h if x.strip() and not x.startswith("#")]
        for n in names:
            p = os.path.join(folder, n)
            if n.startswith(".") or os.path.islink(p):
                continue
            is_dir, drop = os.path.isdir(p), False
            for base, rule in rules:
                keep, r = rule.startswith("!"), rule.lstrip("!")
                if r.endswith("/") and not is_dir:
                    continue
                r, rel = r.rstrip("/"), os.path.relpath(p, base)
                if fnmatch.fnmatch(rel, r.lstrip("/")) if "/" in r else fnmatch.fnmatch(n, r):
                    drop = not keep
            if not drop:
                walk(p, rules) if is_dir else out.append(os.path.relpath(p, root))

    walk(root, [])
    return sorted(out), issues


def tree(spark: SparkSession, root: str, exclude: list[str] = DEFAULT_EXCLUDE) -> tuple[DataFrame, DataFrame]:
    """files (file, language, text, lines) and issues (file, issue).

    Names are listed on the driver, as ignore files need their folders; contents are read by the executors.
    """
    ship(spark)
    names, issues = _ignored(root)
    known = [(n, LANGUAGES[n.rsplit(".", 1)[-1]]) for n in names if n.rsplit(".", 1)[-1] in LANGUAGES and "." in n]
    listed = spark.createDataFrame(known, "file string, language string").where(~F.col("file").rlike(GENERATED)).where(~matches_any(F.col("file"), exclude))
    base = os.path.abspath(root)

    def read(batches):  # Spark's own sources skip names that begin with _, as __init__.py
        from pyarrow import fs

        disk = fs.LocalFileSystem()
        for b in batches:
            texts = []
            for f in b["file"]:
                with disk.open_input_file(f"{base}/{f}") as h:
                    texts.append(h.readall().decode("utf-8", "replace"))
            yield b.assign(text=texts)

    files = listed.repartition(partitions(spark), "file").mapInPandas(read, "file string, language string, text string")
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 6), "\n")
    lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return files.where(~head.rlike(HEADER)).withColumn("lines", lines), spark.createDataFrame([(root, i) for i in issues], "file string, issue string")


def config(root: str, name: str = "lodestrata") -> tuple[dict, list[str]]:
    """Settings from ``<name>.toml``, else the pyproject's ``tool.<name>`` table, else none; and what was wrong with them."""
    for file, pick in ((f"{name}.toml", lambda d: d), ("pyproject.toml", lambda d: d.get("tool", {}).get(name))):
        path = os.path.join(root, file)
        if os.path.exists(path):
            try:
                with open(path, "rb") as f:
                    got = pick(tomllib.load(f))
            except (tomllib.TOMLDecodeError, OSError) as e:
                return {}, [f"{file}: {e}"]
            if got is not None:
                return got, []
    return {}, []


def jsonc(text: str):
    """The value of JSON with comments and trailing commas; a comment's marks inside strings are text."""
    out = re.sub(r'("(?:[^"\\\\]|\\\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.S)
    return json.loads(re.sub(r'("(?:[^"\\\\]|\\\\.)*")|,(\s*[}\]])', lambda m: m.group(1) or m.group(2), out, flags=re.S))


def path_aliases(root: str) -> list[tuple[str, str]]:
    """(pattern, replacement) of the compiler's paths, relative to ``root``; a file that can't be read gives none."""
    for name in ("tsconfig.json", "jsconfig.json"):
        try:
            with open(os.path.join(root, name)) as f:
                options = jsonc(f.read()).get("compilerOptions", {})
        except (OSError, ValueError, AttributeError):
            continue
        base = options.get("baseUrl", ".")
        return [(k, os.path.normpath(os.path.join(base, v[0]))) for k, v in options.get("paths", {}).items() if v]
    return []


def entry_modules(root: str) -> set[str]:
    """Modules that a manifest starts: Python scripts and entry points, Rust binaries."""
    out: set[str] = set()
    for file in ("pyproject.toml", "Cargo.toml"):
        path = os.path.join(root, file)
        if not os.path.exists(path):
            continue
        with open(path, "rb") as f:
            try:
                d = tomllib.load(f)
            except tomllib.TOMLDecodeError:
                continue
        p = d.get("project", {})
        groups = [p.get("scripts", {}), p.get("gui-scripts", {}), *p.get("entry-points", {}).values()]
        out |= {str(t).split(":")[0].strip() for g in groups for t in g.values()}
        out |= {re.sub(r"\.rs$", "", re.sub("^src/", "", b["path"])) for b in d.get("bin", []) if "path" in b}
    return out


def git_diff(spark: SparkSession, root: str, base: str = "HEAD", timeout: int = 30) -> DataFrame:
    """(n, line) of the diff against ``base``; untracked files have their names in lines ``? name``."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=timeout, check=True).stdout.splitlines()
    rows = run("diff", "--unified=0", base) + [f"? {x}" for x in run("ls-files", "--others", "--exclude-standard")]
    return spark.createDataFrame(list(enumerate(rows)), "n long, line string")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(file, lo, hi) that a session's write and edit records touched, from JSON lines; other lines are skipped."""

    def rows(x: str) -> list[tuple[str, int, int]]:
        try:
            d = json.loads(x)
        except ValueError:
            return []
        found, todo = [], [d]
        while todo:
            v = todo.pop()
            if isinstance(v, dict):
                name, text = v.get("file_path"), v.get("content", v.get("new_string"))
                if isinstance(name, str) and isinstance(text, str):
                    lo = int(v.get("start_line", 1))
                    found.append((name, lo, lo + max(0, text.count("\n") - text.endswith("\n"))))
                todo += list(v.values())
            elif isinstance(v, list):
                todo += v
        return found

    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for x in b["value"] for r in rows(x)], columns=["file", "lo", "hi"])

    return spark.read.text(path).mapInPandas(run, "file string, lo long, hi long").distinct()


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's JSON lines; those that can't be parsed are dropped."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where("kind is not null")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
