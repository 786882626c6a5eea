"""Videos: a player's metadata and its caption tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.urls import video_id
from sheaf.operators import verdict as V
from sheaf.operators.media import chosen_track, video_markdown
from sheaf.plans.captures import as_results, data_of, error, provenance_of, sections_column, shaped

TRACKS = "video string, pos int, language string, is_generated boolean, snippets array<string>, error string"


def video_records(captures: DataFrame, tracks: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """Captured videos in the columns of ``read_captures``. ``html`` of a capture holds the player's metadata as JSON.

    ``tracks`` has the columns of ``TRACKS``, ``pos`` from 0 in the order of the player's list; a row with
    ``error`` tells that the list or a track could not be read, and a row of null ``pos`` that the list is empty.
    Of a video's tracks, which are few, the first that a person wrote is taken, else the first. Without rows
    about a video its captions are open. Title and caption make a video complete; a URL without an id is an error.
    """
    rows = captures.withColumns({"video": video_id(F.col("url")), "_info": F.try_parse_json("html")})
    if tracks is None:
        rows = rows.withColumn(
            "tracks", F.lit(None).cast(f"array<struct<{TRACKS.replace('video string, ', '').replace(' ', ':').replace(',:', ',')}>>")
        )
    else:
        one = F.struct(*(F.col(c.split()[0]) for c in TRACKS.split(", ")[1:]))
        listed = tracks.groupBy("video").agg(F.sort_array(F.collect_list(one)).alias("tracks"))
        rows = rows.join(listed, "video", "left")
    get = lambda path, kind="string": F.try_variant_get("_info", path, kind)
    there = F.filter("tracks", lambda t: t["pos"].isNotNull())
    rows = rows.withColumns({"track": chosen_track(there), "title": F.nullif(F.trim(get("$.title")), F.lit(""))})
    text = F.array_join(F.filter(F.transform("track.snippets", lambda t: F.trim(t)), lambda t: t != ""), " ")
    unread = F.coalesce(F.exists("tracks", lambda t: t["error"].isNotNull()) & F.col("track.snippets").isNull(), F.lit(False))
    rows = rows.withColumns(
        {
            "transcript": F.coalesce(text, F.lit("")),
            "heard": F.when(F.col("tracks").isNull() | unread, None).otherwise(F.coalesce(text, F.lit("")) != "")
        }
    )
    chapters = F.transform(
        get("$.chapters", "array<variant>"),
        lambda c: F.struct(
            F.try_variant_get(c, "$.start_time", "double").alias("start_time"), F.try_variant_get(c, "$.title", "string").alias("title")
        )
    )
    bad = F.col("video").isNull()
    rows = rows.withColumns(
        {
            "shown": F.when(bad, "").otherwise(video_markdown(F.col("title"), F.col("video"), get("$.description"), chapters, F.col("transcript"))),
            "signals": V.evidence(player_metadata=F.col("title").isNotNull(), caption_track=F.col("heard"))
        }
    )
    rows, shape = shaped(rows.withColumn("sections", sections_column(F.col("shown"))), budget)
    status = F.when(bad, "unknown").otherwise(V.strict_status(F.col("signals")))
    reason = F.when(bad, "The URL names no video").when(
        status == "complete", "The player's metadata and a caption track agree"
    ).when(status == "incomplete", "The title or a transcript is missing").otherwise("The transcript can't be judged")
    fields = {
        "channel": F.coalesce(get("$.channel"), get("$.uploader")), "upload_date": get("$.upload_date"),
        "duration_seconds": get("$.duration", "double"), "view_count": get("$.view_count", "long"), "like_count": get("$.like_count", "long"),
        "reported_comment_count": get("$.comment_count", "long")
    }
    return as_results(
        rows,
        captures,
        **shape,
        status=status,
        reason=reason,
        evidence=F.col("signals"),
        provenance=provenance_of(set(captures.columns), F.lit(0), F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("video"))),
        structured_data=data_of(F.struct(F.col("video").alias("video_id"), *(c.alias(k) for k, c in fields.items()))),
        failure=F.when(status != "complete", "verification"),
        error=F.when(bad, error("policy", "the URL names no video")),
    )
