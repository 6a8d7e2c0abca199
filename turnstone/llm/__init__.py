"""Training-data operators: deduplication, media, quality, tokens, chat, licences, mixing, URLs, HTML, secrets."""
