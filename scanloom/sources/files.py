"""Skill packages on disk as relations: files, manifests, platforms."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scanloom.functions.dims import LANGUAGES, MANIFEST_NAMES, SKIPPED
from scanloom.packaging import BATCH_BYTES, ready_for_python
from scanloom.sources.manifests import read_manifests

MAX_BYTES = 1 << 20
NUL_CHARACTERS = 8192

# Where each platform keeps skills, in the order in which they are looked through.
PLATFORM_DIRS = {
    "posix": {
        "claude": ["~/.claude/skills", "./.claude/skills", "~/.claude/commands", "./.claude/commands", "~/.claude/plugins/*/skills/*"],
        "openclaw": ["~/.openclaw/workspace/skills", "~/.openclaw/workspace-*/skills", "~/.openclaw/skills", "./skills", "./.agents/skills"],
        "codex": ["~/.agents/skills", "./.agents/skills", "../.agents/skills", "/etc/codex/skills"],
        "hermes": ["~/.hermes/skills", "~/.hermes/skills/*", "./.hermes/skills"],
    },
    "win32": {
        "claude": ["%USERPROFILE%/.claude/skills", "./.claude/skills", "%USERPROFILE%/.claude/commands", "./.claude/commands", "%USERPROFILE%/.claude/plugins/*/skills/*"],
        "openclaw": ["%USERPROFILE%/.openclaw/workspace/skills", "%USERPROFILE%/.openclaw/workspace-*/skills", "%USERPROFILE%/.openclaw/skills", "%APPDATA%/openclaw/skills", "%LOCALAPPDATA%/openclaw/skills", "./skills", "./.agents/skills"],
        "codex": ["%USERPROFILE%/.agents/skills", "./.agents/skills", "../.agents/skills", "%PROGRAMDATA%/codex/skills"],
        "hermes": ["%USERPROFILE%/.hermes/skills", "%USERPROFILE%/.hermes/skills/*", "./.hermes/skills"],
    },
}
# Folders that the search for local skills passes over, and dot folders that it enters.
NOT_SEARCHED = "node_modules .git .turbo .next .cache dist build out coverage target vendor .venv __pycache__".split()
SEARCHED_DOT_FOLDERS = (".claude", ".openclaw", ".agents", ".codex", ".hermes")


def language_of(path: Column) -> Column:
    """Language by extension, else ``unknown``."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(path, ".", -1))), F.lit("unknown"))


def admitted(content: Column, rel_path: Column) -> Column:
    """Of 1 byte to 1 MB, without a NUL at its beginning, and no part of the path on the skip list."""
    size = F.length(content)
    head = F.decode(F.substring(content, 1, NUL_CHARACTERS), "ISO-8859-1")
    return size.between(1, MAX_BYTES) & (F.instr(head, "\x00") == 0) & ~F.arrays_overlap(F.split(rel_path, "/"), F.array(*map(F.lit, SKIPPED)))


def platform_of(path: Column) -> Column:
    """The platform whose name is in the path, the first of these; else null."""
    low = F.lower(path)
    out = F.when(low.contains("claude"), "claude")
    for name in ("openclaw", "hermes", "codex"):
        out = out.when(low.contains(name), name)
    return out


# ---- ignore files


def ignore_rules(text: str) -> list[tuple[re.Pattern, bool, bool, bool]]:
    """Rules in order: expression, whole path or any segment, folders only, taken back."""
    out = []
    for line in (raw.strip() for raw in text.split("\n")):
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        folders, line = line.endswith("/"), line.removesuffix("/").removeprefix("/")
        try:
            out.append((re.compile(glob_expression(line) + r"\Z"), "/" in line, folders, back))
        except re.error:
            continue
    return out


def glob_expression(pattern: str) -> str:
    """``*`` and ``?`` within a segment, ``**`` across segments, classes as they are."""
    parts = re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|.", pattern)
    known = {"**/": "(?:.+/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(known.get(p) or (p if p[0] == "[" and len(p) > 1 else re.escape(p)) for p in parts)


def is_ignored(path: str, rules: list[tuple[re.Pattern, bool, bool, bool]]) -> bool:
    """Whether a file, or a folder above it, is left out: of the rules that match, the last counts."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        here, folder, out = "/".join(parts[:k]), k < len(parts), False
        for expression, whole, folders, back in rules:
            if (folder or not folders) and (expression.match(here) if whole else any(map(expression.match, parts[:k]))):
                out = not back
        if out:
            return True
    return False


# ---- reading


def expand_paths(paths: list[str], env: dict[str, str] | None = None, home: str | None = None) -> list[str]:
    """Paths with ``~``, ``$V``, ``${V}``, ``%V%`` and globs resolved; unknown variables leave a path out."""
    env, out = os.environ if env is None else env, []
    for path in paths:
        names = re.findall(r"%(\w+)%|\$\{(\w+)\}|\$(\w+)", path)
        if any(not env.get(n) for n in map("".join, names)):
            continue
        path = re.sub(r"%(\w+)%|\$\{(\w+)\}|\$(\w+)", lambda m: env["".join(g or "" for g in m.groups())], path)
        path = re.sub(r"\A~(?=/|\Z)", lambda _: home or os.path.expanduser("~"), path)
        out += sorted(glob.glob(path)) if re.search(r"[*?]", path) else [path]
    return list(dict.fromkeys(out))


def _opened(uri: str):
    """The file system of a qualified path and the path in it; stores are those that pyarrow knows."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"\Afile:/(?!/)", "file:///", uri))


def _below(uri: str) -> Iterator[tuple[str, bool, int]]:
    """Names right below a folder: name, whether it is a folder, size; none where there is no such folder."""
    from pyarrow.fs import FileSelector, FileType

    fs, path = _opened(uri)
    for info in fs.get_file_info(FileSelector(path, allow_not_found=True)):
        yield info.base_name, info.type == FileType.Directory, info.size or 0


def _walked(uri: str, folder: str = "") -> Iterator[tuple[str, int]]:
    """Paths and sizes of the files below a folder; folders on the skip list are not entered."""
    for name, is_folder, size in _below(f"{uri}/{folder}".rstrip("/")):
        if name in SKIPPED:
            continue
        if is_folder:
            yield from _walked(uri, f"{folder}{name}/")
        else:
            yield folder + name, size


def _bytes(uri: str) -> bytes:
    fs, path = _opened(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


LISTED = "root string, uri string, skill string, rel_path string, size long"


def list_files(spark: SparkSession, roots: list[str], ignore: bool = True) -> DataFrame:
    """Paths of the skills' files (LISTED), without contents.

    Tasks list skill by skill, dot folders too; folders on the skip list are not
    entered.  ignore: leaves out what a skill's own ``.gitignore`` names (that
    file itself stays).
    """
    ready_for_python(spark)
    names = list(dict.fromkeys(r.rstrip("/") for r in roots))
    uris = [_qualified(spark, r) for r in names]
    tops = []
    for k, (root, uri) in enumerate(zip(names, uris)):
        above, _, last = uri.rpartition("/")
        if not (last.startswith("@") and above in uris[:k]):
            # scopes that are roots themselves, named before, have their skills from there
            tops.append((root, uri, [u.rpartition("/")[2] for u in uris[:k] if u.rpartition("/")[0] == uri and u.rpartition("/")[2].startswith("@")]))

    def skills(batches):
        for batch in batches:
            out = []
            for root, uri, had in zip(*(c.to_pylist() for c in batch.columns)):
                for name, is_folder, _ in _below(uri):
                    if is_folder and name.startswith("@") and name not in had:
                        out += [(root, uri, f"{name}/{inner}") for inner, folder, _ in _below(f"{uri}/{name}") if folder and not inner.startswith(".")]
                    if is_folder and not name.startswith(".") and not name.startswith("@"):
                        out.append((root, uri, name))
            yield _batch(out, "root uri skill")

    def files(batches):
        for batch in batches:
            out = []
            for root, uri, skill in zip(*(c.to_pylist() for c in batch.columns)):
                found = [(path, size) for path, size in _walked(f"{uri}/{skill}") if 0 < size <= MAX_BYTES]
                rules = ignore_rules(_text(_bytes(f"{uri}/{skill}/.gitignore"))) if ignore and any(path == ".gitignore" for path, _ in found) else []
                out += [(root, uri, skill, path, size) for path, size in found if path == ".gitignore" or not (rules and is_ignored(path, rules))]
            yield _batch(out, "root uri skill rel_path size")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame(tops, "root string, uri string, had array<string>").mapInArrow(skills, "root string, uri string, skill string")
    return folders.repartition(parts, "uri", "skill").mapInArrow(files, LISTED)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "size" else pa.string()) for n, c in zip(names.split(), columns)], names=names.split())


def _qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def with_contents(listed: DataFrame) -> DataFrame:
    """Reads the files of a list and adds ``content``; files with a NUL at their beginning are left out.

    Bytes that are no UTF-8 become U+FFFD.  Only paths are dealt to tasks (by
    path, so a large skill is many tasks); contents are read where they are used.
    """
    schema = StructType([*listed.schema, StructField("content", StringType())])

    def run(batches):
        for batch in batches:
            kept, texts, held = [], [], 0
            for i, (uri, skill, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("uri", "skill", "rel_path")))):
                raw = _bytes(f"{uri}/{skill}/{path}")
                if b"\0" in raw[:NUL_CHARACTERS]:
                    continue
                kept.append(i)
                texts.append(_text(raw))
                held += len(raw)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, pa.array(texts, pa.string())], names=schema.names)
                    kept, texts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept, pa.int64())).columns, pa.array(texts, pa.string())], names=schema.names)

    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "uri", "skill", "rel_path").mapInArrow(run, schema)


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        "root",
        F.concat_ws("/", "root", "skill").alias("skill_dir"),
        "rel_path",
        "content" if "content" in files.columns else F.lit(None).cast("string").alias("content"),
        language_of(F.col("rel_path")).alias("language"),
        "size",
        platform_of(F.col("root")).alias("platform"),
    )


def read_files(spark: SparkSession, roots: list[str], shallow: bool = False) -> DataFrame:
    """Files of the skills right below each root: (root, skill_dir, rel_path, content, language, size, platform).

    A skill is a folder below a root, or below an ``@scope`` folder of it;
    folders that begin with a dot are passed over.  shallow: paths only, nothing
    is opened.  Roots that hold no file or are not there give no rows; a skill
    that two roots reach counts for the first.
    """
    listed = list_files(spark, roots, ignore=not shallow)
    return _named(listed if shallow else with_contents(listed))


def read_skills(files: DataFrame) -> DataFrame:
    """(skill_id, skill_dir, platform, manifest_file, manifest) of the folders that have a manifest.

    The id is name@version, with the folder's name where the manifest has none.
    """
    from pyspark.sql import Window as W

    found = read_manifests(files)
    origin = files.groupBy("skill_dir").agg(F.min("platform").alias("platform"))
    name = F.when(F.col("manifest.name") == "unknown", F.substring_index("skill_dir", "/", -1)).otherwise(F.col("manifest.name"))
    skills = found.join(origin, "skill_dir").withColumn("skill_id", F.concat_ws("@", name, F.col("manifest.version")))
    # ids can meet in two folders; the folder then tells them apart
    copies = F.count("*").over(W.partitionBy("skill_id"))
    skills = skills.withColumn("copies", copies).withColumn("skill_id", F.when(F.col("copies") > 1, F.concat_ws("#", "skill_id", "skill_dir")).otherwise(F.col("skill_id")))
    return skills.select("skill_id", "skill_dir", "platform", "manifest_file", "manifest")


def read_package(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Skills and their files, ready for an audit.

    Skills are joined to paths, before anything but manifests is read; so no
    contents are shuffled.  Files of a skill come in the order of their paths,
    so they all have the same ``file_ord``.
    """
    listed = list_files(spark, roots)
    skills = read_skills(_named(with_contents(listed.filter(F.col("rel_path").isin(*MANIFEST_NAMES)))))
    ids = skills.select("skill_id", F.col("skill_dir").alias("dir"))
    mine = listed.join(ids, F.concat_ws("/", "root", "skill") == F.col("dir")).drop("dir")
    files = with_contents(mine).withColumn("file_ord", F.lit(0).cast("long")).withColumn("language", language_of(F.col("rel_path")))
    return skills, files.select("skill_id", "file_ord", "rel_path", "content", "language", "size")


def local_skill_folders(work_dir: str, depth: int = 2) -> list[str]:
    """Folders named ``skills`` below a working folder, at most ``depth`` folders down."""
    out = []
    for entry in sorted(os.scandir(work_dir), key=lambda e: e.name) if os.path.isdir(work_dir) else ():
        if not entry.is_dir(follow_symlinks=False):
            continue
        if entry.name == "skills":
            out.append(entry.path)
        elif depth and entry.name not in NOT_SEARCHED and (not entry.name.startswith(".") or entry.name in SEARCHED_DOT_FOLDERS):
            out += local_skill_folders(entry.path, depth - 1)
    return out


def discover_all(
    spark: SparkSession, work_dir: str | None = None, home: str | None = None, extra: list[str] = (), shallow: bool = False, depth: int = 2, system: str = "posix"
) -> DataFrame:
    """Files of all skills that the platforms keep on this machine or in a working folder, as read_files.

    The roots are the platforms' folders, then ``extra``, then the folders named
    ``skills`` in the working folder.  Each pattern, root and skill counts once,
    where it is met first.
    """
    work_dir = os.path.abspath(work_dir or os.getcwd())
    patterns = [p for paths in PLATFORM_DIRS[system].values() for p in paths] + list(extra) + local_skill_folders(work_dir, depth)
    placed = [os.path.normpath(os.path.join(work_dir, p)) if p.startswith(("./", "../")) else p for p in dict.fromkeys(patterns)]
    return read_files(spark, [p for p in expand_paths(placed, home=home) if os.path.isdir(p)], shallow)
