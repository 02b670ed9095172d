"""Cities for offline reverse geocoding."""

# fixed values, in this order: latitude, longitude, city, region, country, population in thousands
CITIES = """
35.6895|139.6917|Tokyo|Kanto|Japan|13960
35.0116|135.7681|Kyoto|Kansai|Japan|1464
34.6937|135.5023|Osaka|Kansai|Japan|2691
37.5665|126.9780|Seoul|Seoul|South Korea|9776
39.9042|116.4074|Beijing|Beijing|China|21540
31.2304|121.4737|Shanghai|Shanghai|China|26320
22.3193|114.1694|Hong Kong|Hong Kong|China|7482
1.3521|103.8198|Singapore|Singapore|Singapore|5700
13.7563|100.5018|Bangkok|Bangkok|Thailand|10539
21.0285|105.8542|Hanoi|Hanoi|Vietnam|8000
10.7769|106.7009|Ho Chi Minh City|Ho Chi Minh|Vietnam|9000
14.5995|120.9842|Manila|NCR|Philippines|13482
-6.2088|106.8456|Jakarta|Jakarta|Indonesia|10562
3.1390|101.6869|Kuala Lumpur|KL|Malaysia|1808
28.6139|77.2090|Delhi|Delhi|India|32066
19.0760|72.8777|Mumbai|Maharashtra|India|20185
12.9716|77.5946|Bangalore|Karnataka|India|12326
13.0827|80.2707|Chennai|Tamil Nadu|India|11324
22.5726|88.3639|Kolkata|West Bengal|India|14974
24.8607|67.0011|Karachi|Sindh|Pakistan|16094
33.6844|73.0479|Islamabad|ICT|Pakistan|1015
23.8103|90.4125|Dhaka|Dhaka|Bangladesh|10356
25.2048|55.2708|Dubai|Dubai|UAE|3564
29.3759|47.9774|Kuwait City|Kuwait|Kuwait|4000
21.4225|39.8262|Mecca|Makkah|Saudi Arabia|2042
24.7136|46.6753|Riyadh|Riyadh|Saudi Arabia|7677
41.0082|28.9784|Istanbul|Istanbul|Turkey|15462
35.6892|51.3890|Tehran|Tehran|Iran|9259
43.2220|76.8512|Almaty|Almaty|Kazakhstan|1977
51.5074|-0.1278|London|England|United Kingdom|8982
48.8566|2.3522|Paris|Île-de-France|France|2161
52.5200|13.4050|Berlin|Berlin|Germany|3645
52.3676|4.9041|Amsterdam|North Holland|Netherlands|872
50.8503|4.3517|Brussels|Brussels|Belgium|1218
55.6761|12.5683|Copenhagen|Hovedstaden|Denmark|638
59.3293|18.0686|Stockholm|Stockholm|Sweden|975
60.1699|24.9384|Helsinki|Uusimaa|Finland|658
59.9139|10.7522|Oslo|Oslo|Norway|700
64.1466|-21.9426|Reykjavík|Capital|Iceland|135
53.3498|-6.2603|Dublin|Leinster|Ireland|554
55.9533|-3.1883|Edinburgh|Scotland|United Kingdom|488
40.4168|-3.7038|Madrid|Madrid|Spain|3223
41.3851|2.1734|Barcelona|Catalonia|Spain|1620
38.7223|-9.1393|Lisbon|Lisbon|Portugal|544
41.9028|12.4964|Rome|Lazio|Italy|4342
45.4408|12.3155|Venice|Veneto|Italy|258
45.4642|9.1900|Milan|Lombardy|Italy|1378
37.9838|23.7275|Athens|Attica|Greece|664
47.4979|19.0402|Budapest|Budapest|Hungary|1752
50.0755|14.4378|Prague|Prague|Czechia|1318
48.2082|16.3738|Vienna|Vienna|Austria|1931
46.9481|7.4474|Bern|Bern|Switzerland|134
47.3769|8.5417|Zürich|Zürich|Switzerland|421
52.2297|21.0122|Warsaw|Mazowieckie|Poland|1794
55.7558|37.6173|Moscow|Moscow|Russia|12655
59.9311|30.3609|Saint Petersburg|St Petersburg|Russia|5384
30.0444|31.2357|Cairo|Cairo|Egypt|21323
-1.2921|36.8219|Nairobi|Nairobi|Kenya|4397
9.0820|8.6753|Abuja|FCT|Nigeria|3464
6.5244|3.3792|Lagos|Lagos|Nigeria|14862
-26.2041|28.0473|Johannesburg|Gauteng|South Africa|5635
-33.9249|18.4241|Cape Town|Western Cape|South Africa|4618
31.6295|-7.9811|Marrakech|Marrakech-Safi|Morocco|928
33.9716|-6.8498|Rabat|Rabat-Salé|Morocco|580
40.7128|-74.0060|New York|New York|United States|8336
34.0522|-118.2437|Los Angeles|California|United States|3979
41.8781|-87.6298|Chicago|Illinois|United States|2693
29.7604|-95.3698|Houston|Texas|United States|2320
37.7749|-122.4194|San Francisco|California|United States|874
47.6062|-122.3321|Seattle|Washington|United States|753
25.7617|-80.1918|Miami|Florida|United States|467
32.7157|-117.1611|San Diego|California|United States|1423
38.9072|-77.0369|Washington|District of Columbia|United States|705
42.3601|-71.0589|Boston|Massachusetts|United States|695
45.5017|-73.5673|Montréal|Québec|Canada|1780
43.6532|-79.3832|Toronto|Ontario|Canada|2930
49.2827|-123.1207|Vancouver|British Columbia|Canada|675
19.4326|-99.1332|Mexico City|CDMX|Mexico|9209
-23.5505|-46.6333|São Paulo|São Paulo|Brazil|12325
-22.9068|-43.1729|Rio de Janeiro|Rio de Janeiro|Brazil|6748
-34.6037|-58.3816|Buenos Aires|CABA|Argentina|3075
-33.4489|-70.6693|Santiago|Santiago|Chile|6158
-12.0464|-77.0428|Lima|Lima|Peru|10719
4.7110|-74.0721|Bogotá|Bogotá|Colombia|7412
-33.8688|151.2093|Sydney|New South Wales|Australia|5312
-37.8136|144.9631|Melbourne|Victoria|Australia|5078
-27.4698|153.0251|Brisbane|Queensland|Australia|2462
-36.8485|174.7633|Auckland|Auckland|New Zealand|1479
-41.2865|174.7762|Wellington|Wellington|New Zealand|215
"""

Row = tuple[float, float, str, str, str, int]


def rows() -> list[Row]:
    split = (line.split("|") for line in CITIES.strip().splitlines())
    return [(float(a), float(b), c, d, e, int(p)) for a, b, c, d, e, p in split]
