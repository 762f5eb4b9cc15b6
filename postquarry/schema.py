"""The message record and the fixed values of the archive's vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

ADDRESS = T.StructType([T.StructField("name", T.StringType()), T.StructField("addr", T.StringType())])
HEADER = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
ATTACHMENT = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("content_id", T.StringType()),
])
MESSAGE = T.StructType([
    T.StructField("folder", T.StringType()), T.StructField("message_id", T.StringType()), T.StructField("subject", T.StringType()),
    T.StructField("sender", ADDRESS), T.StructField("reply_to", ADDRESS), T.StructField("to", T.ArrayType(ADDRESS)), T.StructField("cc", T.ArrayType(ADDRESS)),
    T.StructField("date_ts", T.TimestampType()), T.StructField("date_local", T.TimestampNTZType()), T.StructField("date_offset_s", T.IntegerType()), T.StructField("date_raw", T.StringType()),
    T.StructField("organization", T.StringType()), T.StructField("newsgroups", T.StringType()), T.StructField("in_reply_to", T.StringType()), T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("priority", T.StringType()), T.StructField("unread", T.BooleanType()), T.StructField("flagged", T.BooleanType()), T.StructField("has_attachments", T.BooleanType()),
    T.StructField("body_text", T.StringType()), T.StructField("body_html", T.StringType()), T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("size", T.LongType()), T.StructField("source", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("error", T.StringType()),
])

# Fixed values of the folder vocabulary, mail headers and limits.
FOLDER_ORDER = ["Inbox", "Unsent Messages", "Drafts", "Templates", "Sent", "Trash", "Junk", "Samples"]
FOLDER_ALIASES = {
    "inbox": "Inbox", "in": "Inbox", "outbox": "Unsent Messages", "unsent messages": "Unsent Messages", "draft": "Drafts", "drafts": "Drafts", "templates": "Templates",
    "sent": "Sent", "sent items": "Sent", "sent mail": "Sent", "sent messages": "Sent", "deleted items": "Trash", "trash": "Trash", "junk": "Junk", "junk e-mail": "Junk",
    "spam": "Junk", "archive": "Archive",
}
SENT_LIKE = ["Sent", "Drafts", "Unsent Messages", "Templates"]
DELIVERY_HEADERS = ["Delivered-To", "X-Original-To", "Envelope-To", "X-Envelope-To", "X-Apparently-To", "X-RcptTo"]
UNDATED, OTHER_ACCOUNT, UNKNOWN_ACCOUNT = "Undated", "Other Recipients", "Unknown Recipient"
PRIORITIES = {"1": "Highest", "urgent": "Highest", "2": "High", "high": "High", "3": "", "normal": "", "4": "Low", "low": "Low", "5": "Lowest", "non-urgent": "Lowest"}
PRIORITY_RANK = {"Highest": 5, "High": 4, "Normal": 3, "Low": 2, "Lowest": 1}
STOPWORDS = "the and for you are with this that from have was not but all can will has our your they".split()
LABEL_STATES = ["important", "starred", "unread", "opened", "archived", "all mail", "category personal", "category social", "category promotions", "category updates", "category forums"]
LABEL_FOLDERS = {"inbox": "Inbox", "sent": "Sent", "draft": "Drafts", "drafts": "Drafts", "trash": "Trash", "bin": "Trash", "spam": "Junk", "junk": "Junk"}
LABEL_PRIORITY = ["Drafts", "Sent", "Trash", "Junk", "Inbox"]
FIELD_SUBJECT, FIELD_SENDER, FIELD_RECIPIENT, FIELD_BODY, FIELD_ATTACHMENT = 1, 2, 4, 8, 16
FLAG_ATTACHED, FLAG_FLAGGED, FLAG_UNREAD = 1, 2, 4
BODY_TOKENS, QUOTE_CHARS, QUOTE_LINES, UID_BODY_CHARS, RESULTS = 4000, 1400, 40, 4096, 500
ATTACHMENT_BYTES, FILENAME_CHARS = 64 << 20, 120
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
