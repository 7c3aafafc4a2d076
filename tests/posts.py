"""Helpers of the tests: post rows with fixed instants, and rows as tuples."""

import datetime as dt

from chorus.schema import POST_SCHEMA

BASE = dt.datetime(2024, 1, 10)


def post(i, content="text", platform="twitter", author="testuser", label="POSITIVE", score=0.8, ts=None,
         likes=None, retweets=None, engagement=None, query="test", hashtags=None, mentions=None, title=None,
         subreddit=None, id=None, seq=None):
    """A post row in POST_SCHEMA (fixed instants instead of 'now')."""
    if engagement is None:
        engagement = {"likes": float(10 * i if likes is None else likes),
                      "retweets": float(5 * i if retweets is None else retweets)}
    md = {f.name: None for f in POST_SCHEMA["metadata"].dataType.fields}
    md.update(hashtags=hashtags if hashtags is not None else (["test", "data"] if i % 2 == 0 else []),
              mentions=mentions if mentions is not None else (["user1"] if i % 3 == 0 else []),
              subreddit=subreddit)
    sent = None if label is None else {"label": label, "score": score, "method": "transformer", "compound": None,
                                       "original_text": None, "details": None}
    return (i if seq is None else seq, str(i) if id is None else id, platform, author, str(100 + i), content, title,
            ts or BASE - dt.timedelta(hours=i), engagement, f"https://{platform}.com/{i}", query, md, sent)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
