"""Still pictures, frame rates and probe measurements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallowick.functions import vocab

FLAT_BELOW = 12


def gradient_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """16 hex digits from an array of ``width * height`` grey values: a bit says whether a pixel is darker than the next in its row."""
    bit = lambda i: F.when(F.get(pixels, F.lit(i // (width - 1) * width + i % (width - 1))) < F.get(pixels, F.lit(i // (width - 1) * width + i % (width - 1) + 1)), "1").otherwise("0")
    bits = F.concat(*(bit(i) for i in range((width - 1) * height)))
    return F.when(F.size(pixels) == width * height, hex_of_bits(bits))


def hex_of_bits(bits: Column, n: int = 64) -> Column:
    """A string of ``n`` binary digits as lower-case hex; by eights, since 64-bit conversions are signed."""
    part = lambda i: F.lpad(F.lower(F.conv(F.substring(bits, i + 1, 32), 2, 16)), 8, "0")
    return F.concat(*(part(i) for i in range(0, n, 32)))


def _halves(h: Column) -> tuple[Column, Column]:
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two hashes of 16 hex digits."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_halves(a), _halves(b), strict=True)), start=F.lit(0))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of grey values; 255 where one is missing or their sizes differ."""
    diff = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0), 255.0).otherwise(diff / F.size(a))


def contrast(pixels: Column) -> Column:
    return F.array_max(pixels) - F.array_min(pixels)


def motion(frames: Column) -> Column:
    """Mean difference of neighbouring frames, null below two frames."""
    pairs = F.zip_with(F.slice(frames, F.lit(1), F.size(frames) - 1), F.slice(frames, F.lit(2), F.size(frames) - 1), mean_difference)
    return F.when(F.size(frames) >= 2, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs))


def cadence(fps: Column) -> Column:
    rate, out = F.round(fps, 2), None
    for name, rates in vocab.CADENCES.items():
        out = F.when(rate.isin(*rates), name) if out is None else out.when(rate.isin(*rates), name)
    return out


def frame_rate(fraction: Column) -> Column:
    """``num/den`` as a number of three places, 0 if it isn't one."""
    part = lambda i: F.get(F.split(fraction, "/"), F.lit(i)).try_cast("double")
    return F.coalesce(F.round(F.try_divide(part(0), F.coalesce(part(1), F.when(~fraction.contains("/"), 1.0))), 3), F.lit(0.0))


def duration(text: Column) -> Column:
    """A positive, finite number of seconds, else null."""
    value = text.try_cast("double")
    return F.when((value > 0) & (value < float("inf")), value)


def no_frame_reason(rate_limited: Column, has_picture: Column, decoded: Column, kbps: Column, errors: Column) -> Column:
    """Why a stream with video gave no picture: refused, declined, or simply none."""
    return F.when(F.coalesce(rate_limited, F.lit(False)), "rate limited").when(served_nothing(has_picture, decoded, kbps, errors), "provider declined").otherwise("no frame")


def served_nothing(has_picture: Column, decoded: Column, kbps: Column, errors: Column) -> Column:
    """A connection that delivered errors and nothing else."""
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    return ~F.coalesce(has_picture, F.lit(False)) & zero(decoded) & zero(kbps) & (F.coalesce(errors, F.lit(0)) > 0)


def several_rates(variants: Column) -> Column:
    return F.coalesce(variants, F.lit(1)) > 1


def several_rates_dash(variants: Column, container: Column) -> Column:
    """Several renditions in a DASH manifest, by the container that the metadata name."""
    return several_rates(variants) & F.lower(F.coalesce(container, F.lit(""))).contains("dash")


def slow_fetch(seconds: Column, sample: Column, timed_out: Column) -> Column:
    """A capture that took nine tenths of the sample's length or more, and ended."""
    return ~F.coalesce(timed_out, F.lit(False)) & (F.coalesce(seconds, F.lit(0)) >= sample * 0.9)


# What decoders and servers write of progress, damage and refusals, and how long a decoder takes to start.
PROGRESS = r"^frame=.*\btime=(\d+):(\d+):([\d.]+)"
DAMAGE = "(?i)NALU|PPS|SPS|corrupt|invalid|concealing|no frame|non-existing|missing picture|decode_slice|Invalid data|error while decoding"
REFUSAL = r"(?i)\b429\b|Too Many Requests|\b403\b|forbidden"
WARMUP = 2.0


def damage(text: Column) -> Column:
    """A struct of what a decoder's messages say: errors, damaged at the start and after it, seconds decoded, steady damage per second, refused.

    Lines of progress date the lines after them; damage within the first two seconds is the start's.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), F.trim), lambda x: x != "")
    clock = lambda x, i: F.regexp_extract(x, PROGRESS, i)
    seconds = lambda x: F.when(clock(x, 3) != "", clock(x, 1).try_cast("long") * 3600 + clock(x, 2).try_cast("long") * 60 + clock(x, 3).try_cast("double"))
    zero = F.lit(0).cast("int")
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("decoded"), zero.alias("errors"), zero.alias("startup"), zero.alias("steady"))

    def step(acc: Column, line: Column) -> Column:
        at = seconds(line)
        bad = at.isNull() & line.rlike(DAMAGE)
        count = lambda name, rule: (acc[name] + F.when(rule, 1).otherwise(0)).alias(name)
        return F.struct(F.coalesce(at, acc["at"]).alias("at"), F.greatest(acc["decoded"], F.coalesce(at, F.lit(0.0))).alias("decoded"), count("errors", at.isNull()), count("startup", bad & (acc["at"] < WARMUP)), count("steady", bad & (acc["at"] >= WARMUP)))

    def done(acc: Column) -> Column:
        window = F.greatest(F.lit(1.0), acc["decoded"] - WARMUP)
        return F.struct(acc["errors"].alias("errors"), acc["startup"].alias("startup"), acc["steady"].alias("steady"), F.round(acc["decoded"], 1).alias("decoded"), F.round(acc["steady"] / window, 2).alias("per_second"), F.coalesce(text.rlike(REFUSAL), F.lit(False)).alias("refused"))

    return F.aggregate(lines, start, step, done)


def best_rendition(streams: Column) -> Column:
    """Of an array of structs the video stream of the largest picture, the first of equals."""
    video = F.filter(streams, lambda s: s["codec_type"] == "video")
    area = lambda s: F.coalesce(s["width"], F.lit(0)) * F.coalesce(s["height"], F.lit(0))
    most = F.array_max(F.transform(video, area))
    return F.get(F.filter(video, lambda s: area(s) == most), F.lit(0))


def first_audio(streams: Column) -> Column:
    return F.get(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(0))


def crop(box: Column, width: Column, height: Column) -> Column:
    """A box of fractions of a frame as whole pixels inside it, at least one wide and high."""
    part = lambda share, whole: F.greatest(F.lit(0), F.least(whole - 1, F.floor(share * whole))).cast("int")
    x, y = part(box["x"], width), part(box["y"], height)
    size = lambda share, whole, at: F.greatest(F.lit(1), F.least(whole - at, F.round(share * whole))).cast("int")
    return F.struct(x.alias("x"), y.alias("y"), size(box["w"], width, x).alias("w"), size(box["h"], height, y).alias("h"))


def status(has_metadata: Column, has_video: Column, finite: Column, has_picture: Column, corruption: Column, corruption_limit: float = 1.0) -> Column:
    """The result of a probe: the first rule that applies."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(no(has_metadata), "dead").when(no(has_video), "no_video").when(finite.isNotNull(), "placeholder").when(no(has_picture), "no_frame").when(F.coalesce(corruption, F.lit(0.0)) > corruption_limit, "dirty").otherwise("ok")
