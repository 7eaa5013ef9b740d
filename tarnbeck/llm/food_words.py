"""Words around a typed food name that do not change what it is, and traditional characters."""

TRADITIONAL = dict(
    zip(
        "烏亞體兒蘭凍鳳劑鹵滷發鹹圓塊團複復頭夾嬰帶乾幹擺掛無殺雜極構棗檸氣湯漿濃漬滿滅爐燉煉煙燒熱愛犛豬瑪鹽種筍糧纖紅純線結綠維縮羅腸膠臘脫節蘆蘋藥蕎萊蓮蘿蔥藍蝦蠶裝見調穀貝質軟輕過進適選醬釀裡針鈣鈉鉀鐵鈴銀鋁鍋鋅鎂長門間陽陳難雛麵麪韓預顆顏風飛飯飲飼餃餅餡館饅馬驢駝駱魚魷鮑鮮鯉鯽鱷鱈鰻鳥雞鷄鴨鴕鵝鷹麥麩黃龍燻薰醃榖產貨農爾樣試網購買檢復臨開號將採傳冊箱貼紙機劉製餘雲嶺硯滷衛東當與類營養無麼從餵飴籽鬆",
        "乌亚体儿兰冻凤剂卤卤发咸圆块团复复头夹婴带干干摆挂无杀杂极构枣柠气汤浆浓渍满灭炉炖炼烟烧热爱牦猪玛盐种笋粮纤红纯线结绿维缩罗肠胶腊脱节芦苹药荞莱莲萝葱蓝虾蚕装见调谷贝质软轻过进适选酱酿里针钙钠钾铁铃银铝锅锌镁长门间阳陈难雏面面韩预颗颜风飞饭饮饲饺饼馅馆馒马驴驼骆鱼鱿鲍鲜鲤鲫鳄鳕鳗鸟鸡鸡鸭鸵鹅鹰麦麸黄龙熏熏腌谷产货农尔样试网购买检复临开号将采传册箱贴纸机刘制余云岭砚卤卫东当与类营养无么从喂饴籽松",
        strict=True,
    )
)

# Regular expressions over the unified form: what may stand before or after a name.
BEFORE = (
    r"【[^】]{1,12}】",
    r"\[[^\]]{1,12}\]",
    r"\w{1,4}牌(?=\S)",
    r"(?:散装|袋装|盒装|瓶装|罐装|进口|国产|网购|自制|农家|超市买的|市场买的|大包装|小包装|产地直供|现做|家庭装|特价|新品)",
    r"(?:样品|试样|检样|留样|送检|复检|名称|品名)\s*[-:_.、#]?",
    r"(?:请|需|待|拟)(?:检验|检测|化验|抽检|复检|送检)(?:一下)?\s*[-:_.、#]?",
    r"(?:各?[一两半整](?:大|小|整)?(?:份|袋|盒|瓶|包|罐|箱|斤|个)|\d+\s*(?:份|袋|盒|瓶|包|罐|箱|斤|个))",
)
QUANTITY = r"\d+(?:\.\d+)?\s*(?:kg|g|mg|ml|l|千克|公斤|克|毫升|升|斤|两|盒|袋|瓶|包|罐|箱|份|个|只|支|件|片装|粒装)"
NOTE = r"(?:散装|袋装|盒装|瓶装|罐装|临期|已开封|未开封|开封|复检|样品|试样|留样|进口|国产|自制|\d+\s*号样?|第[一二三四五六七八九十\d]+批|各?[一两半整](?:大|小|整)?(?:份|袋|盒|瓶|包|罐|箱)|" + QUANTITY + ")"
AFTER = (
    r"[!。.?;,、:~…]+",
    r"[-—_ ]*\(\s*" + NOTE + r"\s*\)",
    r"[-—_ ]*\[\s*" + NOTE + r"\s*\]",
    r"[-—_/ ]*" + NOTE,
    r"\s*[x×*]\s*\d+",
    r"/\s*(?:袋|盒|瓶|包|罐|箱|份|个|只|支|件|斤)",
)
