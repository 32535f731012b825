"""Small posts for tests; all content is invented."""

from datetime import datetime

AUTHOR = "struct<id:string,screen_name:string,name:string,profile_image_url:string,verified:boolean,followers_count:bigint,following_count:bigint>"
MEDIA = "array<struct<type:string,url:string,media_url:string,preview_image_url:string,width:int,height:int,local_path:string>>"
TWEETS = f"id string, text string, created_at string, author {AUTHOR}, retweet_count bigint, favorite_count bigint, reply_count bigint, quote_count bigint, view_count bigint, lang string, is_retweet boolean, is_quote boolean, media {MEDIA}, urls array<string>, hashtags array<string>, mentions array<string>, conversation_id string, in_reply_to_user_id string, fetched_at timestamp"


def post(ident, text="", created="Sun Nov 09 11:05:17 +0000 2025", handle="ann", author="1", name="Ann", verified=False, fav=0, media=None, urls=None, hashtags=None, fetched=datetime(2025, 12, 1), lang="en", views=0):
    who = (author, handle, name, None, verified, 1, 1) if author is not None or handle is not None else None
    return (ident, text, created, who, 0, fav, 0, 0, views, lang, False, False, media, urls or [], hashtags or [], [], None, None, fetched)


def photo(url="https://t.example/a", media_url="https://media.example/a.png", kind="photo", local=None):
    return (kind, url, media_url, None, 1, 1, local)


def frame(spark, *posts):
    return spark.createDataFrame(list(posts), TWEETS)
