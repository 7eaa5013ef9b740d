"""Characters that look like others, after compatibility normalisation."""

# Radical forms and the ordinary characters they look like.
RADICALS = dict(
    zip(
        "⺁⺃⺄⺅⺆⺇⺈⺉⺊⺋⺌⺍⺎⺏⺐⺑⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺟⺠⺡⺢⺣⺤⺥⺦⺨⺩⺫⺬⺭⺮⺯⺰⺱⺲⺴⺵⺶⺷⺸⺹⺺⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻰",
        "厂乚乙亻冂刂⺈刂卜㔾小小尢尣尢尢巳幺彑彐忄心扌攵旡日月歺母民氵氺灬爫爫丬犭王罒示礻竹糸纟罒罒网罓羊羊羊耂肀月臼艹艹艹虎衤西西见角讠贝车辶阝钅長镸长门阜阝雨青韦页风飞食飠饣饣马骨鬼鱼鸟卤麦黄黾齐齿龙",
        strict=False,
    )
)
RADICALS = {k: v for k, v in RADICALS.items() if k != v}

# Cyrillic and Greek letters drawn like Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗаеѕіјорсухԁԛԝһҮҺӀӏ", "ABESIJKMHOPCTYX3aesijopcyxdqwhYhIl", strict=True))
CYRILLIC.pop("З")
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo", strict=True))
#: These stand for a Latin letter only between Latin letters; alone they are Greek.
GREEK_INSIDE = dict(zip("ανρικυχγ", "avpikuxy", strict=True))
TO_LATIN = CYRILLIC | GREEK
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items() if k in "АВЕЅІЈКМНОРСТХаеѕіјорсух"}
# Katakana drawn like Chinese characters.
KANA = dict(zip("エカニトロタハチ", "工力二卜口夕八千", strict=True))
