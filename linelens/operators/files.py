"""File-level checks: validation of inspection files, batch and folder profiles, annotation inventory."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import beside, q
from linelens.operators.ordered import attach
from linelens.session import materialize


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def folders(path: Column) -> Column:
    """Folder names of a relative path, the file name left out."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def class_folder(path: Column) -> Column:
    """First folder that names a normal or defect class; split folders are skipped."""
    hit = F.filter(folders(path), lambda p: ~F.lower(p).isin(*fixed.SPLIT_FOLDERS) & (F.lower(p).isin(*fixed.NORMAL_FOLDERS) | p.rlike("(?i)" + fixed.DEFECT_FOLDERS)))
    return F.get(hit, F.lit(0))


def split_folder(path: Column) -> Column:
    hit = F.lower(F.get(F.filter(folders(path), lambda p: F.lower(p).isin(*fixed.SPLIT_FOLDERS)), F.lit(0)))
    out = F.when(F.lit(False), "")
    for name, split in fixed.SPLIT_FOLDERS.items():
        out = out.when(hit == name, split)
    return out.otherwise(None)


def _number(content: Column, start: int | Column, size: int, little: bool) -> Column:
    """Unsigned number from bytes (1-based start); null where the content ends before it."""
    start = F.lit(start) if isinstance(start, int) else start
    there = F.length(content) >= start + (size - 1)
    if not little:
        return F.when(there, F.conv(F.hex(F.substring(content, start, F.lit(size))), 16, 10).cast("long"))
    places = [F.conv(F.hex(F.substring(content, start + i, F.lit(1))), 16, 10).cast("long") * 256**i for i in range(size)]
    return F.when(there, reduce(add, places))


def image_format(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    return (F.when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("47494638"), "GIF")
            .when(head.startswith("424D"), "BMP").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF")
            .when(head.startswith("52494646") & head.endswith("57454250"), "WEBP"))


#: JPEG markers and TIFF entries looked at before a file counts as unreadable.
MAX_MARKERS = 1024


def _sides(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def _jpeg_sides(data: Column) -> Column:
    """From marker to marker, each with its length, up to the frame header; image data or a broken marker ends the walk."""
    none = F.lit(None).cast("long")

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker = _number(data, at, 2, False)
        code = marker - 0xFF00
        state = lambda to, width=none, height=none: F.struct(to.cast("long").alias("at"), width.alias("width"), height.alias("height"))
        frame = code.between(0xC0, 0xCF) & ~code.isin(0xC4, 0xC8, 0xCC)
        return (F.when(at.isNull(), s).when(marker.isNull() | (code < 1) | code.isin(0xD9, 0xDA), state(none))
                .when(code == 0xFF, state(at + 1)).when((code == 1) | code.between(0xD0, 0xD8), state(at + 2))
                .when(frame, state(none, _number(data, at + 7, 2, False), _number(data, at + 5, 2, False)))
                .otherwise(state(at + 2 + _number(data, at + 2, 2, False))))

    start = F.struct(F.lit(3).cast("long").alias("at"), none.alias("width"), none.alias("height"))
    steps = F.sequence(F.lit(1), F.least(F.lit(MAX_MARKERS), F.length(data)))
    walked = F.aggregate(steps, start, step)
    return _sides(walked["width"], walked["height"])


def _tiff_sides(data: Column, little: bool) -> Column:
    """Tags 256 and 257 of the first directory, as 16-bit or 32-bit numbers."""
    first = _number(data, 5, 4, little) + 1
    count = F.least(_number(data, first, 2, little), F.lit(MAX_MARKERS))
    entries = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(count, F.lit(0))), lambda k: first + 2 + k * 12)

    def tag(n: int) -> Column:
        found = F.filter(entries, lambda at: (at < first + 2 + count * 12) & (_number(data, at, 2, little) == n))
        value = F.transform(found, lambda at: F.when(_number(data, at + 2, 2, little) == 3, _number(data, at + 8, 2, little)).when(
            _number(data, at + 2, 2, little) == 4, _number(data, at + 8, 4, little)))
        return F.get(value, F.lit(0))

    return _sides(tag(256), tag(257))


def _webp_sides(data: Column) -> Column:
    """The first chunk: a key frame (VP8), a lossless head (VP8L) or the canvas (VP8X)."""
    chunk, packed = F.hex(F.substring(data, 13, 4)), _number(data, 22, 4, True)
    key = F.hex(F.substring(data, 24, 3)) == "9D012A"
    lossless = F.hex(F.substring(data, 21, 1)) == "2F"
    return (F.when((chunk == "56503820") & key, _sides(_number(data, 27, 2, True) % 16384, _number(data, 29, 2, True) % 16384))
            .when((chunk == "5650384C") & lossless, _sides(packed % 16384 + 1, F.shiftright(packed, 14) % 16384 + 1))
            .when(chunk == "56503858", _sides(_number(data, 25, 3, True) + 1, _number(data, 28, 3, True) + 1)))


def image_size(content: Column) -> tuple[Column, Column]:
    """Width and height as the file's head states them, read without decoding; null where it cannot be read.

    The content is bound once to a lambda variable: the walks look at many of its places.
    """
    kind = image_format(content)

    def sides(data: Column) -> Column:
        tiff = F.when(F.hex(F.substring(data, 1, 1)) == "49", _tiff_sides(data, True)).otherwise(_tiff_sides(data, False))
        return (F.when(kind == "PNG", _sides(_number(data, 17, 4, False), _number(data, 21, 4, False)))
                .when(kind == "GIF", _sides(_number(data, 7, 2, True), _number(data, 9, 2, True)))
                .when(kind == "BMP", _sides(_number(data, 19, 4, True), _number(data, 23, 4, True)))
                .when(kind == "JPEG", _jpeg_sides(data)).when(kind == "TIFF", tiff).when(kind == "WEBP", _webp_sides(data)))

    size = F.get(F.transform(F.array(content), sides), F.lit(0))
    return size["width"], size["height"]


def validate_files(files: DataFrame, order: str = "position", max_bytes: int | None = None) -> DataFrame:
    """files: original_name, content, <order>. One status per file; nothing is dropped.

    A file without content, of unknown form, or whose head does not give its size is unreadable; pixels are not
    decoded. ``max_bytes`` is the caller's limit on a file's size.

    The first valid file of a content is kept, later copies are duplicates. The first one comes
    from an aggregate and is attached hot-key safe, so many copies never meet in one task.
    """
    name, content = F.col("original_name"), F.col("content")
    files = files.select(order, "original_name", "content", F.struct(*[c.alias(n) for c, n in zip(image_size(content), ("width", "height"))]).alias("_size"))
    kind, width, height = image_format(content), F.col("_size.width"), F.col("_size.height")
    unreadable = kind.isNull() | width.isNull() | height.isNull()
    suffix = suffix_of(name)
    size = F.length(content)
    small = F.coalesce(width < fixed.MIN_IMAGE_SIDE, F.lit(False)) | F.coalesce(height < fixed.MIN_IMAGE_SIDE, F.lit(False))
    large = F.coalesce(size > max_bytes, F.lit(False)) if max_bytes is not None else F.lit(False)
    status = (F.when(~suffix.isin(*fixed.BATCH_SUFFIXES), "unsupported").when(large, "invalid")
              .when(unreadable | small, "invalid").otherwise("valid"))
    reason = (F.when(~suffix.isin(*fixed.BATCH_SUFFIXES), "unsupported format").when(large, f"file exceeds {max_bytes} bytes")
              .when(unreadable, "unreadable image").when(small, "image too small"))
    read = files.select(order, "original_name", size.alias("size_bytes"), status.alias("status"), reason.alias("reason"), width.alias("width"),
                        height.alias("height"), kind.alias("format"), F.sha2(content, 256).alias("sha256"),
                        F.when(F.contains(name, F.lit("/")), F.element_at(F.split(name, "/"), -2)).alias("class_folder"))
    return mark_duplicates(materialize(read), order)  # the contents are read once


def mark_duplicates(read: DataFrame, order: str) -> DataFrame:
    """Files without content have no digest and are never copies; they bypass the join."""
    valid = F.col("status") == "valid"
    blank = read.where("sha256 is null").select(order, "original_name", "size_bytes", "status", "reason", "width", "height", "format", "sha256", "class_folder")
    read = read.where("sha256 is not null")
    first = read.groupBy("sha256").agg(F.min(F.when(valid, F.struct(q(order), F.col("original_name")))).alias("_first"), F.count(F.lit(1)).alias("n"))
    joined = attach(read, first, ["sha256"])
    copy = valid & (q(order) != F.col(f"_first.{order}"))
    return joined.select(order, "original_name", "size_bytes", F.when(copy, "duplicate").otherwise(F.col("status")).alias("status"),
                         F.when(copy, F.concat(F.lit("duplicate of "), F.col("_first.original_name"))).otherwise(F.col("reason")).alias("reason"),
                         "width", "height", "format", "sha256", "class_folder").unionByName(blank)


def batch_summary(validated: DataFrame) -> DataFrame:
    """Status counts, class counts, balance and label availability of a batch: one row."""
    status = F.col("status")
    totals = validated.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(status == s).alias(s) for s in ("valid", "invalid", "unsupported", "duplicate")])
    classes = validated.where("class_folder is not null").groupBy("class_folder").agg(F.count(F.lit(1)).alias("n"))
    shape = classes.agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    joined = beside(totals, shape)
    has = F.col("classes") > 0
    balanced = (F.col("classes") <= 1) | (F.col("largest") <= F.col("smallest") * 4)
    return joined.select("total", "valid", "invalid", "unsupported", "duplicate", "classes", has.alias("labels_available"),
                         F.when(~has, "NOT_APPLICABLE").when(balanced, "BALANCED").otherwise("IMBALANCED").alias("class_balance"))


def folder_profile(images: DataFrame) -> DataFrame:
    """images: path (relative). Counts per kind and the suitability of the set for each use: one row."""
    tagged = images.select("path", class_folder(F.col("path")).alias("c"), split_folder(F.col("path")).alias("s"), suffix_of(F.col("path")).alias("x"))
    tagged = tagged.where(F.col("x").isin(*fixed.IMAGE_SUFFIXES))
    normal = F.lower("c").isin(*fixed.NORMAL_FOLDERS)
    per = tagged.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s").isNotNull()).alias("in_split"), F.count_if(
        F.regexp_extract(F.lower(F.element_at(F.split("path", "/"), -1)), "(mask|seg)", 1) != "").alias("masks"))
    named = F.col("c").isNotNull()
    row = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("image_count"), F.count_if(named).alias("class_folders"),
                  F.min(F.when(named, F.col("n"))).alias("smallest_class"), F.coalesce(F.sum(F.when(normal, F.col("n"))), F.lit(0)).alias("normal_count"),
                  F.coalesce(F.sum(F.when(named & ~normal, F.col("n"))), F.lit(0)).alias("defect_count"), F.coalesce(F.sum("in_split"), F.lit(0)).alias("in_split"),
                  F.coalesce(F.sum("masks"), F.lit(0)).alias("masks"))
    usable = (F.col("class_folders") >= 2) & (F.col("smallest_class") >= 10)
    return row.select("*", F.coalesce(usable, F.lit(False)).alias("classification"), (F.col("normal_count") >= 20).alias("anomaly_detection"),
                      (F.col("masks") > 0).alias("localization"))


def format_counts(images: DataFrame) -> DataFrame:
    return images.select(suffix_of(F.col("path")).alias("format")).where(F.col("format").isin(*fixed.IMAGE_SUFFIXES)).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def annotation_kind(path: Column, content: Column) -> Column:
    """Which annotation form a file is, if any. content: its text."""
    name, suffix = F.element_at(F.split(path, "/"), -1), suffix_of(path)
    parent = F.lower(F.when(F.size(F.split(path, "/")) > 1, F.element_at(F.split(path, "/"), -2)))
    keys = F.json_object_keys(content)
    coco = (suffix == "json") & name.rlike("(?i)" + fixed.ANNOTATION_JSON_NAMES) & F.array_contains(keys, "images") & F.array_contains(keys, "annotations")
    voc = (suffix == "xml") & content.rlike(r"(?is)^\s*(<\?xml[^>]*\?>)?\s*(<!--.*?-->\s*)*<annotation[\s>]")
    yolo = (suffix == "txt") & parent.isin(*fixed.YOLO_FOLDERS)
    mask = suffix.isin(*fixed.IMAGE_SUFFIXES) & F.lower(name).rlike("mask|seg")
    return (F.when(F.coalesce(coco, F.lit(False)), "coco_json").when(F.coalesce(voc, F.lit(False)), "voc_xml").when(F.coalesce(yolo, F.lit(False)), "yolo_labels")
            .when(mask, "mask").when(F.lower(name).isin(*fixed.METADATA_FILES), "metadata"))


def annotation_inventory(files: DataFrame) -> DataFrame:
    """files: path, content (text). Number of files of each annotation form."""
    return files.select(annotation_kind(F.col("path"), F.col("content")).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


def vision_status(profile: DataFrame) -> DataFrame:
    """PROFILED when images support at least one use; else why not."""
    uses = F.array_compact(F.array(*[F.when(F.col(u), F.lit(u)) for u in ("classification", "anomaly_detection", "localization")]))
    return profile.select("image_count", F.when(F.col("image_count") == 0, "NOT_SUPPORTED").when(F.size(uses) > 0, "PROFILED").otherwise(
        "PROFILED_NO_SUPPORTED_CAPABILITY").alias("status"), F.array_join(uses, ", ").alias("supported"))
