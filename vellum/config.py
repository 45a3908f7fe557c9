"""Limits and the plan catalogue, in one place."""

from __future__ import annotations

FREE_CHARS, FREE_MB = 1_000_000, 20
CREDIT_MB, ADMIN_MB = 50, 200
#: The largest file that the service can be sent.
SERVICE_MB = 2000
BATCH_ITEMS, BATCH_CHARS = 150, 9000
REQUEST_ITEMS, REQUEST_CHARS = 400, 30_000
FAILS, COOL_FAILS, COOL_PING, COOL_BUSY = 5, 120, 60, 15
MIN_SPLIT_KB, MAX_SPLIT_KB, MIN_SPLIT_BYTES = 512, 2000 * 1024, 256 * 1024
DAY = 86_400

#: Key, title, kind, price, currency, days, daily files (0: no limit), credits, MB, queue priority.
PLAN_COLUMNS = "plan string, title string, kind string, price long, currency string, days long, daily_limit long, credits long, max_mb long, priority int"
PLANS = [
    ("starter", "Starter Pack", "credits", 10, "INR", 0, 0, 5, 50, 1),
    ("bulk", "Bulk Pack", "credits", 40, "INR", 0, 0, 25, 50, 1),
    ("basic", "Basic", "sub", 50, "INR", 30, 5, 0, 50, 1),
    ("premium", "Premium", "sub", 100, "INR", 30, 0, 0, 200, 0),
    ("premium3", "Premium 3 Months", "sub", 250, "INR", 90, 0, 0, 200, 0),
    ("stars", "Premium · Stars", "sub", 60, "XTR", 30, 0, 0, 200, 0),
]

#: Extension, kind, label.
FORMATS = [
    (".epub", "epub", "EPUB"), (".pdf", "pdf", "PDF"), (".docx", "docx", "DOCX"), (".txt", "txt", "TXT"),
    (".md", "txt", "Markdown"), (".html", "html", "HTML"), (".htm", "html", "HTML"), (".xhtml", "html", "XHTML"),
]
#: Kinds of files that can be read and written here; the others need a library that lays out pages.
READABLE, WRITABLE = ("epub", "docx", "txt", "html"), ("epub", "docx", "txt", "html")
#: Media type, extension.
MEDIA = [
    ("application/epub+zip", ".epub"), ("text/plain", ".txt"), ("text/markdown", ".md"), ("text/html", ".html"), ("application/xhtml+xml", ".xhtml"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"), ("application/pdf", ".pdf"),
]
#: First bytes in hex, extension, media type.
MAGIC = [
    ("89504E47", ".png", "image/png"), ("FFD8", ".jpg", "image/jpeg"), ("47494638", ".gif", "image/gif"), ("424D", ".bmp", "image/bmp"),
    ("49492A00", ".tif", "image/tiff"), ("4D4D002A", ".tif", "image/tiff"),
]
