"""A small labelled URL table, to train the URL classifier on: (url, 1 if unwanted)."""

# Hand-labelled URLs.
LABELLED = [
    ("http://cheap-pills.example.com/buy/now", 1), ("https://www.cheap-pills.example.org/order", 1), ("http://spam-farm.example.org/en/728", 1), ("https://spam-farm.example.net/links/1", 1),
    ("http://casino-bonus.example.com/win", 1), ("https://www.free-casino.example.net/play/slots", 1), ("http://online-poker-cash.example.org/jackpot", 1), ("http://win-money-fast.example.com/click", 1),
    ("https://adult-cams.example.com/live", 1), ("http://xxx-videos.example.net/free", 1), ("http://hot-singles.example.org/date/tonight", 1), ("https://payday-loans.example.com/apply/now", 1),
    ("http://replica-watches.example.net/shop/cheap", 1), ("http://seo-backlinks.example.org/buy/1000", 1), ("https://link-farm.example.com/page/5", 1), ("http://viagra-discount.example.com/pills", 1),
    ("http://crypto-doubler.example.net/send", 1), ("https://free-gift-cards.example.org/claim", 1), ("http://clickbait-farm.example.com/top10", 1), ("http://warez-cracks.example.net/download/keygen", 1),
    ("https://torrent-cracked.example.org/serial", 1), ("http://weight-loss-miracle.example.com/order", 1), ("http://best-pills-online.example.net/cheap", 1), ("https://spam-links.example.com/out/77", 1),
    ("http://getrich-quick.example.org/offer", 1), ("http://lottery-winner.example.net/claim/prize", 1), ("https://bet-casino-slots.example.com/bonus", 1), ("http://fake-followers.example.org/buy", 1),
    ("https://docs.example.com/en/guide/install.html", 0), ("http://news.example.org/2021/05/science", 0), ("https://www.university.example.net/research/papers", 0), ("http://blog.example.com/en/853/", 0),
    ("https://library.example.org/catalog/item/12", 0), ("http://weather.example.net/de/berlin", 0), ("https://recipes.example.com/fr/825", 0), ("http://museum.example.org/es/533/", 0),
    ("https://m.travel.example.net/en/25", 0), ("http://forum.example.com/thread/44821", 0), ("https://wiki.example.org/wiki/History", 0), ("http://city-council.example.net/minutes/2019", 0),
    ("https://health.example.org/en/nutrition", 0), ("http://www.school.example.com/en/classes", 0), ("https://journal.example.net/article/671.html", 0), ("http://music.example.org/artist/9", 0),
    ("https://blog.tion.example.com/en/7198", 0), ("http://ththan.example.org/de/12440", 0), ("https://www.thering.example.net/fr/34463", 0), ("http://m.ander.example.com/es/26123", 0),
    ("https://garden.example.org/en/12213", 0), ("http://history.example.net/en/9897/", 0), ("https://open-data.example.com/sets/41", 0), ("http://www.books.example.org/title/676", 0),
    ("https://code.example.net/repo/issues", 0), ("http://astronomy.example.com/stars", 0), ("https://archive.example.org/en/960", 0), ("http://theater.example.net/program", 0),
]
