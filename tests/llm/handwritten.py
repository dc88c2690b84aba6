"""Sentences written by hand, with the personal data in them that the base patterns don't find; none of them comes from the templates."""

SAMPLE = [
    ("You can reach Marta at marta.klein (at) posteo (dot) de until Friday.", ["marta.klein (at) posteo (dot) de"]),
    ("Please send the invoice to billing[at]northwind[dot]com as soon as possible.", ["billing[at]northwind[dot]com"]),
    ("Her new address is j.ortega at gmail dot com, the old one bounces.", ["j.ortega at gmail dot com"]),
    ("write me: sam @ example . org", ["sam @ example . org"]),
    ("contact info(at)stadtwerke(dot)de for a refund", ["info(at)stadtwerke(dot)de"]),
    ("Questions? support [at] acme [dot] io, we answer within a day.", ["support [at] acme [dot] io"]),
    ("The office number is (212) 555-0187, ask for Dana.", ["(212) 555-0187"]),
    ("Call me on 415-555-2671 after six.", ["415-555-2671"]),
    ("Fax: 030/555 0199, phone the same with 0198.", ["030/555 0199"]),
    ("My cell is 646.555.0143 but text first.", ["646.555.0143"]),
    ("tel 0044 20 7946 0958 during office hours", ["0044 20 7946 0958"]),
    ("Reception: (020) 7946 0018.", ["(020) 7946 0018"]),
    ("His mobile 0049 151 555 0123 was switched off.", ["0049 151 555 0123"]),
    ("Paid with card 4556/7375/8689/9855 on Monday.", ["4556/7375/8689/9855"]),
    ("The credit card number 5425.2334.3010.9903 was declined.", ["5425.2334.3010.9903"]),
    ("visa 4916_6734_7572_5015, expires next year", ["4916_6734_7572_5015"]),
    ("The server at 192[.]168[.]10[.]4 stopped answering.", ["192[.]168[.]10[.]4"]),
    ("Login from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 at midnight.", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("blocked host 10(dot)0(dot)12(dot)7 in the firewall", ["10(dot)0(dot)12(dot)7"]),
    ("Her address at home. Dot your letters carefully.", []),
    ("We looked at Berlin. He stayed in Rome. Nobody came.", []),
    ("The museum opened in 1998 204 years after the town.", []),
    ("See pages 120-145 3320 of the appendix.", []),
    ("Version 10.4 . 2 . 1 fixes the crash.", []),
    ("Order 4412-8831-0092 21 has shipped.", []),
    ("The ratio was 3:4:5:6 in all samples.", []),
    ("They met at noon. Lunch was served. Then rain fell.", []),
    ("Section 12.3.4.5.6 of the code applies.", []),
    ("It cost 1200 400 2000 in three parts.", []),
    ("Meeting at 10:30, room 204 210 3300.", []),
    ("Train 555 1234 left from platform 2.", []),
    ("Population: 1,204,555 (2019) and 1,310,020 (2023).", []),
    ("The date 2023-10-14 2210 was printed twice.", []),
    ("Part numbers 7781/2231/9920/114 and 7781/2231/9921/115 fit.", []),
    ("He is good at chess dot com puzzles are fun", []),
    ("Score 21-19 21-17 in the final.", []),
    ("Latitude 52.5200 longitude 13.4050 altitude 34.", []),
    ("An offer at amazon . It ends soon . Hurry .", []),
    ("The hash 9f:86:d0:81:88:4c:7d:65 is short.", []),
    ("ISBN 978-3-16-148410-0 is a book.", []),
]
