"""Dumps of sites: download, extraction, and the corpora of foreign sites."""

from __future__ import annotations

import json
import shutil
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodeseek.operators.dataset import build_corpus
from lodeseek.sources.posts import read_posts, shift_ids

MEMBERS = ("Posts.xml", "PostLinks.xml", "Tags.xml")


def download(url: str, target: str, force: bool = False) -> dict:
    """Fetches a file unless one of the announced length is there; a transfer cut short is removed and an error. Gives url,
    bytes, last_modified and whether it was fetched, and writes them as dump_info.json beside the file."""
    path = Path(target)
    path.parent.mkdir(parents=True, exist_ok=True)
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD")) as head:
        length, modified = int(head.headers.get("Content-Length") or -1), head.headers.get("Last-Modified")
    fetched = force or not path.exists() or length < 0 or path.stat().st_size != length
    if fetched:
        with urllib.request.urlopen(url) as source, path.open("wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
        if length >= 0 and path.stat().st_size != length:
            got = path.stat().st_size
            path.unlink()
            raise OSError(f"{got} of {length} bytes arrived")
    info = {"url": url, "bytes_downloaded": path.stat().st_size, "last_modified": modified, "fetched": fetched}
    (path.parent / "dump_info.json").write_text(json.dumps(info, indent=2) + "\n")
    return info


def extract(archive: str, target: str, members: tuple[str, ...] = MEMBERS) -> list[str]:
    """Extracts members of a 7z archive (needs the py7zr package) or of a format that shutil knows; KeyError names what is missing."""
    Path(target).mkdir(parents=True, exist_ok=True)
    if archive.endswith(".7z"):
        try:
            import py7zr
        except ImportError as e:
            raise RuntimeError("extracting 7z archives needs the py7zr package") from e
        with py7zr.SevenZipFile(archive) as z:
            z.extract(target, [m for m in members if m in z.getnames()])
    else:
        shutil.unpack_archive(archive, target)
    missing = [m for m in members if not (Path(target) / m).exists()]
    if missing:
        raise KeyError(f"not in the archive: {', '.join(missing)}")
    return [str(Path(target) / m) for m in members]


def load_site(spark: SparkSession, site: str, folder: str) -> DataFrame:
    """The corpus of a foreign site's extracted dump, its ids moved into the site's range."""
    _, answers = read_posts(spark, f"{folder}/{site}/Posts.xml")
    return shift_ids(build_corpus(answers), site, ["answer_id", "question_id"])
